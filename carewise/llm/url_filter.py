"""URL rules and block lists as cascades of Bloom filters, in DataFrame functions only.

A cascade answers exactly for a known universe of keys, here every key that any URL of the corpus
can ask for. Its first filter holds the listed keys, the second the keys of the universe that the
first takes for listed, the third the listed keys that the second takes for false, and so on
until a level has no mistakes left. The first level that misses a key decides. The filters are
some ten bits per key of their level, so they travel as constants within the query plan and no
join is needed. Filters above FILTER_BYTES would be too large for that: then the listed keys are
joined instead, with the same answers.

Defined cases: a null URL, or one without "://", has an empty host and path, fits no rule and is
allowed; of rules that fit, the longest counts, and of equally long ones the smallest; rows that
repeat an id are judged one by one; an empty table gives an empty result; other columns are kept
by ``judge``, except those named like a result, which are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carewise.session import stored

BITS_PER_KEY = 10
HASHES = 5
FILTER_BYTES = 8 << 20

HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host and its subdomains, for paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def rule_keys(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """Every key under which a rule for this URL could be listed: the host and its parents, each
    with the starts of the path that are as long as some rule's path."""
    labels = F.split(host, "[.]", -1)
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(
        F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda s: s.isNotNull()
    )
    return F.array_distinct(F.flatten(F.transform(parents, lambda p: F.transform(starts, lambda s: F.concat(p, s)))))


# ------------------------------------------------------------ cascades

@dataclass(frozen=True)
class Cascade:
    """Filters (bits, seed) by level."""

    levels: tuple[tuple[bytes, int], ...]

    def has(self, key: Column) -> Column:
        """Whether a key of the universe is listed; without any level nothing is."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for number in reversed(range(len(self.levels))):
            answer = F.when(in_filter(key, *self.levels[number]), answer).otherwise(F.lit(number % 2 == 1))
        return answer


def _places(key: Column, bits: int, seed: int) -> list[Column]:
    first, second = (F.pmod(F.xxhash64(key, F.lit(s)), F.lit(bits)) for s in (seed, seed + 1_000_003))
    return [(first + second * i) % bits for i in range(HASHES)]


def in_filter(key: Column, cells: bytes, seed: int) -> Column:
    """Whether all bits of a key are set."""
    data = F.lit(bytearray(cells))
    hit = F.lit(True)
    for place in _places(key, 8 * len(cells), seed):
        cell = F.ascii(F.decode(F.substring(data, (F.floor(place / 8) + 1).cast("int"), F.lit(1)), "ISO-8859-1"))
        hit = hit & (F.call_function("shiftright", cell, (place % 8).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return hit


def bloom_filter(keys: DataFrame, count: int, seed: int) -> bytes:
    """The filter of ``count`` keys (key): one row per byte comes to the driver."""
    size = max(8, -(-count * BITS_PER_KEY // 8))
    place = keys.select(F.explode(F.array(*_places(F.col("key"), 8 * size, seed))).alias("place"))
    cells = place.groupBy(F.floor(F.col("place") / 8).alias("cell")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("place") % 8).cast("int"))).alias("bits")
    )
    out = bytearray(size)
    for row in cells.toLocalIterator():
        out[row["cell"]] = row["bits"]
    return bytes(out)


def cascade(listed: DataFrame, others: DataFrame, limit: int = FILTER_BYTES) -> Cascade | None:
    """The cascade of distinct stored keys (key) against all other keys of the universe; None if
    a filter would be larger than ``limit`` bytes."""
    levels: list[tuple[bytes, int]] = []
    inside, outside = listed, others
    while True:
        count = inside.count()
        if not count:
            return Cascade(tuple(levels))
        if count * BITS_PER_KEY > 8 * limit:
            return None
        level = bloom_filter(inside, count, 2 * len(levels)), 2 * len(levels)
        levels.append(level)
        # what the new filter takes wrongly is the next level's content
        inside, outside = stored(outside.filter(in_filter(F.col("key"), *level)), "taken-wrongly"), inside


# ------------------------------------------------------------ judging

def judge(pages: DataFrame, rules: Sequence[Rule], blocked: DataFrame, limit: int = FILTER_BYTES, url: str = "url") -> DataFrame:
    """The pages with ``host``, ``path``, ``rule`` and ``verdict``.

    The longest rule that fits decides; without one, hosts in ``blocked`` (host) are blocked and
    all others allowed.
    """
    lengths = sorted({len(r.path) for r in rules})
    parsed = pages.drop("host", "path", "rule", "verdict").withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    asked = parsed.select("host", rule_keys(F.col("host"), F.col("path"), lengths).alias("keys"))
    keys = stored(asked.select(F.explode("keys").alias("key")).distinct(), "url-keys")
    hosts = stored(asked.select(F.col("host").alias("key")).distinct(), "url-hosts")

    names = [r.key for r in rules]
    is_rule = F.col("key").isin(names)
    of_rules = cascade(stored(keys.filter(is_rule), "rules-met"), keys.filter(~is_rule), limit)
    listed = stored(blocked.select(F.col("host").alias("key")).distinct().join(hosts, "key", "left_semi"), "hosts-met")
    of_hosts = cascade(listed, hosts.join(listed, "key", "left_anti"), limit)

    found = rule_keys(F.col("host"), F.col("path"), lengths)
    member = (lambda k: of_rules.has(k)) if of_rules is not None else (lambda k: k.isin(names))
    fitting = F.filter(found, member)
    longest = F.array_min(F.transform(fitting, lambda k: F.struct((-F.char_length(k)).alias("size"), k.alias("key"))))["key"]
    verdicts = F.lit(None).cast("string")
    for rule in rules:
        verdicts = F.when(F.col("rule") == rule.key, rule.verdict).otherwise(verdicts)
    ruled = parsed.withColumn("rule", longest)
    if of_hosts is None:
        marked = listed.select(F.col("key").alias("_host"), F.lit(True).alias("_listed"))
        ruled = ruled.join(marked, ruled["host"] == marked["_host"], "left")
        listed_host = F.coalesce("_listed", F.lit(False))
    else:
        listed_host = of_hosts.has(F.col("host"))
    verdict = F.coalesce(verdicts, F.when(listed_host, "block").otherwise("allow"))
    return ruled.withColumn("verdict", verdict).drop("_host", "_listed")


def hosts_with_words(pages: DataFrame, words: Sequence[str], url: str = "url") -> DataFrame:
    """(host) of the pages whose name has one of the words between dots or hyphens."""
    pattern = "(^|[.-])(" + "|".join(words) + ")([.-]|$)"
    return pages.select(url_host(F.col(url)).alias("host")).distinct().filter(F.col("host").rlike(pattern))
