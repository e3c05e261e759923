"""A small labelled table of hosts and paths, made of common words of spam and of other sites.

Every top-level domain, language path, subdomain and parent domain comes with both labels equally often, so that only
the words of host and path tell the labels apart.
"""

from __future__ import annotations

from itertools import cycle

from pyspark.sql import DataFrame, SparkSession

#: Words that spam sites name themselves by.
SPAM = (
    "casino poker roulette blackjack jackpot slots slot bet bets betting wager gambling lottery lotto bingo winner bonus spins "
    "pills pharma viagra cialis meds steroids slimming weightloss cheap discount replica fake knockoff coupon deals "
    "adult porn xxx sex escort camgirls nude hookup dating milf loans loan payday credit fastcash forex getrich profit doubler "
    "warez cracked keygen torrent nulled hack cheats malware phishing spam spammer linkfarm clickbait popups adserver ads track tracker clicks "
    "seolinks backlinks prize giveaway free win freegift"
).split()
#: Words of other sites; some hold a spam word's letters.
CLEAN = (
    "news times herald journal weather city garden kitchen recipes cooking travel hotel museum gallery library school college university campus "
    "science physics biology chemistry mathematics history archive books reading poetry music concert theatre cinema film radio television sport "
    "football cycling running hiking mountain river forest ocean island village parish council government ministry hospital clinic dentist health nurse "
    "bank insurance lawyer justice court engineering software linux python database docs manual wiki forum blog mail maps photo camera design "
    "furniture fashion shoes bakery coffee restaurant farm farmers animal horse bird fishing boats railway airport motor bicycle house home family children "
    "essex sussex middlesex classic alphabet between freedom freelance window winter windmill darwin tracks railtrack soundtrack addresses "
    "roads uploads leads spanish dating-archaeology adults-learning creditunion betony sextant pillow caterpillar pharmacy cheapside profitable-reading shops market store"
).split()
SYLLABLES = "ka lo mi ren tor vel sha dun ber gan ith ond est oul ari ter sen tion ther onan wel ster and ere ing ance ould ith me lod an ri no pa vi che qui zu bra gro fel hin jor kest lun mor nev ost pra rud sil tam urs vand wim yor zel al bo cer dro em fi gu hy im".split()
ENDS = ("com", "org", "net", "info", "io", "eu")
PARENTS = ("", "example.", "site.", "")
LANGUAGES = ("en", "de", "fr", "es", "")
SUBDOMAINS = ("", "www.", "m.", "blog.")


def rows() -> list[tuple[str, str, int]]:
    """(host, path, label 1 = block), each combination of the frame with either label."""
    n = len(SYLLABLES)
    plain = [SYLLABLES[i % n] + SYLLABLES[(i * 7 + i // n * 5 + 3) % n] + (SYLLABLES[(i * 11 + i // n * 3 + 5) % n] if i % 2 else "") for i in range(1200)]
    pairs = lambda words, k: [words[i] + ("-", "")[i % 2] + words[(i * 5 + k) % len(words)] for i in range(len(words))]
    named = {1: [*SPAM, *pairs(SPAM, 7), *pairs(SPAM, 20)], 0: [*CLEAN, *plain, *pairs(CLEAN, 7)]}
    spam_mixed = [f"{w}-{plain[(i * 3) % len(plain)]}" for i, w in enumerate(SPAM)] + [f"{CLEAN[(i * 3) % len(CLEAN)]}-{w}" for i, w in enumerate(SPAM)]
    names = {1: cycle(named[1] + spam_mixed), 0: cycle(named[0])}
    words = {1: cycle(SPAM), 0: cycle(CLEAN)}
    out, k = [], 0
    for _ in range(4):
        for end in ENDS:
            for parent in PARENTS:
                for language in LANGUAGES:
                    for sub in SUBDOMAINS[:: 2 if k % 2 else 1]:
                        k += 1
                        page = f"/{k * 7919 % 10_000}{('', '/', '.html')[k % 3]}"
                        start = f"/{language}" if language else ""
                        for label in (0, 1):
                            out.append((f"{sub}{next(names[label])}.{parent}{end}", start + page, label))
                        if k % 5 == 0:  # words of the path: on plain hosts, with either label
                            host = f"{sub}{next(names[0])}.{parent}{end}"
                            out += [(host, f"{start}/{next(words[label])}{page}", label) for label in (0, 1)]
    return out


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), "host string, path string, label int").coalesce(1)  # of fixed size
