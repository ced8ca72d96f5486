"""URL filters: rules and a block list as sorted 64-bit digests in a memory-mapped file.

A rule is a host and the start of a path, as in ``example.com/en/7``. It fits its host and all
subdomains of it, if the URL's path starts with the rule's. The longest rule that fits decides (of
two as long, the one with the longer host). Where none fits, a host on the block list, or below one,
is blocked and any other allowed.

Every key string is stored under its 64-bit xxhash in one sorted array. A batch of URLs is probed at
once with a vectorised binary search, and a hit counts only if the stored full string is the same.

Defined results
---------------
* A null URL, or one without ``://``, has an empty host and path; it fits no rule and is allowed.
* Hosts are lower-cased for A-Z only, and keep a port or user name that stands in them.
* A block list is a sequence of hosts or a table with a column ``host``. In both, A-Z are lower-cased, nulls,
  empty names and names with a slash, ``?`` or ``#`` stand for no host and are left out, and repeated ones count
  once. Hosts of rules are taken as they stand.
* Repeated rules: the last one's verdict holds. An empty rule list or table works as expected.
* Repeated rows are judged alike; other columns are never read. URLs of any length are judged whole: a URL has
  as many keys as its host has ends times the different lengths of the rules' paths.

At scale
--------
No shuffle. The index travels as one broadcast whose size is checked (``MOST_BYTES``); each Python
worker writes it to an unlinked temporary file of its own and maps it. A table of hosts is digested and sorted by
Spark, measured first, and comes to the driver as Arrow columns only below that bound; there it is laid out
without a Python object a host. A longer list is applied by ``joined``, which explodes each URL's candidate
keys and joins the list as a table.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Production parameters. (rule, verdict), and blocked hosts.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
BLOCKED = ("spam-farm.example.org", "cheap-pills.example.com")
#: Bound on the broadcast index.
MOST_BYTES = 64 << 20


class DigestArray:
    """Key strings with a small value each: sorted digests, values, ends and the strings, in a map.

    The file holds the number of keys, the digests (8 bytes each), the places where the strings end
    (8), the values (1) and the strings, in the order of the digests.
    """

    def __init__(self, buffer: np.ndarray):
        n = int(buffer[:8].view(np.uint64)[0])
        self.digests = buffer[8 : 8 + 8 * n].view(np.uint64)
        self.ends = buffer[8 + 8 * n : 8 + 16 * n].view(np.uint64)
        self.values = buffer[8 + 16 * n : 8 + 17 * n]
        self.strings = buffer[8 + 17 * n :]

    @staticmethod
    def packed(items: Iterable[tuple[str, int]], digest=xxhash.xxh64_intdigest) -> bytes:
        rows = [(digest(k), k, v) for k, v in {k.encode(): v for k, v in items}.items()]
        return DigestArray.sorted(np.array([d for d, _, _ in rows], np.uint64), pa.array([k for _, k, _ in rows], pa.large_binary()), np.array([v for _, _, v in rows], np.uint8))

    @staticmethod
    def sorted(digests: np.ndarray, strings: pa.LargeBinaryArray, values: np.ndarray) -> bytes:
        """Different strings, their digests and values, laid out in the order of the digests."""
        order = np.argsort(digests, kind="stable")
        own = strings.take(pa.array(order))
        ends = np.cumsum(pc.binary_length(own).to_numpy(zero_copy_only=False).astype(np.uint64), dtype=np.uint64)
        text = np.frombuffer(own.buffers()[2] or b"", np.uint8)[: int(ends[-1]) if len(ends) else 0]
        head = [np.array([len(order)], np.uint64), digests[order].astype(np.uint64), ends, values[order].astype(np.uint8)]
        return b"".join(x.tobytes() for x in (*head, text))

    @classmethod
    def mapped(cls, packed: bytes) -> "DigestArray":
        with tempfile.TemporaryFile() as file:
            file.write(packed)
            file.flush()
            return cls(np.memmap(file, np.uint8, "r"))

    def string(self, at: int) -> bytes:
        return self.strings[int(self.ends[at - 1]) if at else 0 : int(self.ends[at])].tobytes()

    def find(self, keys: list[bytes], digest=xxhash.xxh64_intdigest) -> np.ndarray:
        """The place of each key, or -1."""
        found = np.full(len(keys), -1, np.int64)
        if not keys or not len(self.digests):
            return found
        wanted = np.fromiter(map(digest, keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, wanted)
        todo = np.flatnonzero(at < len(self.digests))
        todo = todo[self.digests[at[todo]] == wanted[todo]]
        for i in todo.tolist():
            k = int(at[i])
            while k < len(self.digests) and self.digests[k] == wanted[i]:
                if self.string(k) == keys[i]:
                    found[i] = k
                    break
                k += 1
        return found


_MAPS: dict[str, DigestArray] = {}


def _mapped(packed: bytes) -> DigestArray:
    """One map of a list in each Python worker."""
    name = hashlib.sha256(packed).hexdigest()
    if name not in _MAPS:
        _MAPS.clear()
        _MAPS[name] = DigestArray.mapped(packed)
    return _MAPS[name]


def lowered(host: Column) -> Column:
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(host, upper, upper.lower())


def host_list(blocked: DataFrame, host_col: str = "host") -> DataFrame:
    """The different hosts of a table, A-Z lower-cased, as a column ``rule``; see the module's defined results."""
    rules = blocked.select(lowered(F.col(f"`{host_col}`")).alias("rule"))
    return rules.filter((F.col("rule") != "") & ~F.col("rule").rlike("[/?#]")).distinct()


def host_and_path(url: Column) -> tuple[Column, Column]:
    """A URL's host, lower-cased for A-Z, and its path; both empty if there is no ``://``."""
    host, path = (F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit("")) for k in (1, 2))
    return lowered(host), path


def suffixes(host: str) -> Iterator[str]:
    """The host and every domain above it, longest first."""
    while host:
        yield host
        _, dot, host = host.partition(".")
        if not dot:
            return


class UrlJudge:
    """Rules and blocked hosts over one digest array; values: 0 allow, 1 block, 2 blocked host."""

    def __init__(self, index: DigestArray, lengths: tuple[int, ...]):
        self.index, self.lengths = index, lengths

    def __call__(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str]]:
        keys, owner = [], []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            for s in suffixes(host):
                own = [f"{s}{path[:n]}".encode() for n in self.lengths if n <= len(path)] + [s.encode()]
                keys += own
                owner += [i] * len(own)
        at = self.index.find(keys)
        rules: list[str | None] = [None] * len(hosts)
        verdicts, best = ["allow"] * len(hosts), [(0, 0)] * len(hosts)
        for j in np.flatnonzero(at >= 0).tolist():
            i, rule, value = owner[j], keys[j].decode(), int(self.index.values[at[j]])
            rank = (len(rule), rule.find("/"))
            if value == 2:
                if rules[i] is None:
                    verdicts[i] = "block"
            elif rank > best[i]:
                best[i], rules[i], verdicts[i] = rank, rule, ("allow", "block")[value]
        return rules, verdicts


def packed_lists(hosts: DataFrame, rules: list[tuple[str, str]]) -> bytes:
    """The digest array of both lists; hosts are digested in tasks and come here as columns."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [x.as_py() for x in batch.column(0).cast(pa.binary())]
            digests = np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own))
            yield pa.RecordBatch.from_arrays([pa.array(digests.view(np.int64)), pa.array(own, pa.binary())], ["digest", "key"])

    found = hosts.select("rule").mapInArrow(digested, "digest long, key binary").toArrow()
    names = [r.encode() for r, _ in rules]
    digests = np.concatenate((found["digest"].to_numpy().view(np.uint64), np.array([xxhash.xxh64_intdigest(r) for r in names], np.uint64)))
    keys = pa.concat_arrays([c.cast(pa.large_binary()) for c in (*found["key"].chunks, pa.array(names, pa.binary()))])
    values = np.array([2] * found.num_rows + [int(v == "block") for _, v in rules], np.uint8)
    return DigestArray.sorted(digests, keys, values)


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, blocked=BLOCKED) -> DataFrame:
    """Each page's id, host, path, the rule that fits (or null) and the verdict. ``blocked`` is a sequence of
    hosts, or a table that has them as ``host``."""
    bad = [r for r, v in rules if "/" not in r or v not in ("allow", "block")]
    if bad:
        raise ValueError(f"a rule is a host, a path from its first slash on, and allow or block: {bad}")
    spark = pages.sparkSession
    rules = list(dict(rules).items())
    lengths = tuple(sorted({len(r) - r.index("/") for r, _ in rules}))
    if not isinstance(blocked, DataFrame):
        blocked = spark.createDataFrame([(h,) for h in blocked], "host string")
    hosts = host_list(blocked)
    size = hosts.agg(F.sum(F.octet_length("rule") + F.lit(17))).first()[0] or 0
    if size + sum(len(r.encode()) + 17 for r, _ in rules) > MOST_BYTES:
        own = spark.createDataFrame(rules, "rule string, verdict string")
        return joined(pages, hosts.withColumn("verdict", F.lit("host")).unionByName(own), lengths, id_col, url_col)
    packed = packed_lists(hosts, rules)
    shared = spark.sparkContext.broadcast(packed)

    @F.pandas_udf("rule string, verdict string")
    def verdict(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        judge = UrlJudge(_mapped(shared.value), lengths)
        for host, path in batches:
            found = judge(host.tolist(), path.tolist())
            yield pd.DataFrame(dict(zip(("rule", "verdict"), found)), dtype=object)

    host, path = host_and_path(F.col(f"`{url_col}`"))
    out = pages.select(F.col(f"`{id_col}`"), host.alias("host"), path.alias("path")).withColumn("found", verdict("host", "path"))
    return out.select(id_col, "host", "path", "found.rule", "found.verdict")


def joined(pages: DataFrame, rules: DataFrame, lengths: Iterable[int], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The same verdicts by a join, for lists of any size: ``rules`` has different rules and their verdicts (allow,
    block, or host for a blocked host), ``lengths`` the lengths of their paths. Rows are told apart by their
    content, so that repeated ids are judged one by one."""
    host, path = host_and_path(F.col(f"`{url_col}`"))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"))
    urls = rows.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    own = F.filter(F.array(*map(F.lit, sorted({0, *lengths}))), lambda k: k <= F.length("path"))
    starts = F.transform(own, lambda k: F.left(F.col("path"), k))
    keys = urls.select("host", "path", F.explode(F.filter(ends, lambda x: x != "")).alias("end"), starts.alias("starts"))
    keys = keys.select("host", "path", "end", F.explode("starts").alias("start")).select("host", "path", F.concat("end", "start").alias("rule"))
    hit = keys.join(rules, "rule").groupBy("host", "path").agg(
        F.max_by(F.struct("rule", "verdict"), F.when(F.col("verdict") == "host", F.struct(F.lit(-1), F.lit(0))).otherwise(F.struct(F.length("rule"), F.instr("rule", "/")))).alias("best")
    )
    by_host = F.col("best.verdict") == "host"
    named = hit.select("host", "path", F.when(~by_host, F.col("best.rule")).alias("rule"), F.when(by_host, "block").otherwise(F.col("best.verdict")).alias("verdict"))
    out = rows.join(named, ["host", "path"], "left")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
