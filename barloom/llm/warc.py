"""WARC archives: writing, and reading back in splits by boundary chains.

Writing: a record for each page, through Spark's text writer, so that archives
land in any store that Spark can write to. A record is its head, an empty line
and its block; the writer's line separator is the two line ends after a block.
Payloads of at least `SHARED` bytes that occur more than once are written once,
with the record of the largest page_id; the others become revisit records.

Reading: the archives are read in splits at every occurrence of the magic
"WARC/1.1" line, whether it begins a record or stands in a payload. Each task
emits what it finds: a candidate's head gives its length and so its successor,
and within a split successors are followed by pointer jumping, which gives
where each candidate's chain leaves the split. Chains are then followed from
split to split from each file's start, by pointer jumping too (a row for each
candidate that begins a chain in its split; as many joins as the logarithm of
the splits in a file). That gives each split's entry; a second pass marks what
pointer jumping reaches from there. Only candidates on the chain from offset 0
are records; magic inside a payload is never reached and becomes part of its
record's block. This holds for files of one split as for others.

Null html is an empty payload, a null url an empty one. Rows with equal
page_id and payload: all of them are responses if theirs is the largest
page_id. A null page_id is less than any other; where a payload has no other,
all its rows are responses. Payloads are written and read whole, however long.
An empty table gives an archive without records, and an empty result.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.shared import fan_out, materialise, shared_dir

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
SHARED = 1000
ROWS_PER_FILE = 50_000
BROADCAST_BYTES = 32 << 20
REVISIT_BYTES = 80  # of a revisit's mark: two numbers and a digest of 20 bytes, as a row
_M = MAGIC.encode()
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value) -> object:
    return F.concat(F.lit(f"{name}: "), value if not isinstance(value, str) else F.lit(value), F.lit("\r\n"))


def records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, size, refers_to (null for responses)."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        # what would end a head's line is percent-coded
        F.regexp_replace(F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    thin = rows.filter(F.col("size") >= SHARED).select("page_id", "digest")
    first = thin.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").select("digest", "refers_to")
    again = thin.join(first, "digest").filter("refers_to is not null and (page_id is null or page_id < refers_to)")
    again = materialise(again.select(F.col("page_id").alias("from_id"), F.unhex("digest").alias("mark"), "refers_to").distinct(), "revisits")
    if again.count() * REVISIT_BYTES <= BROADCAST_BYTES:  # beyond that, a sort-merge join
        again = F.broadcast(again)
    same = rows["page_id"].eqNullSafe(again["from_id"]) & (F.unhex(rows["digest"]) == again["mark"])
    return rows.join(again, same, "left").drop("from_id", "mark")


def write(pages: DataFrame, at: str) -> None:
    """Archives for all pages in folder `at`."""
    response = F.col("refers_to").isNull()
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("none")))
    head = F.concat(
        F.lit(MAGIC),
        _line("WARC-Type", F.when(response, "response").otherwise("revisit")),
        _line("WARC-Record-ID", F.concat(F.lit("<"), name(F.col("page_id")), F.lit(">"))),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Date", _DATE),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(response, F.lit("")).otherwise(
            F.concat(
                _line("WARC-Profile", _PROFILE), _line("WARC-Refers-To", F.concat(F.lit("<"), name(F.col("refers_to")), F.lit(">"))),
                _line("X-Payload-Length", F.col("size").cast("string"))
            )
        ),
        _line("Content-Type", "text/html"),
        _line("Content-Length", F.when(response, F.col("size")).otherwise(0).cast("string")),
        F.lit("\r\n"),
    )
    # cast to string keeps bytes as they are
    body = F.concat(head.cast("binary"), F.when(response, F.col("payload")).otherwise(F.lit(b""))).cast("string").alias("value")
    records(pages).select(body).write.option("lineSep", END).option("maxRecordsPerFile", ROWS_PER_FILE).text(at)


_HEAD = re.compile(rb"(?im)^([A-Za-z-]+):[ \t]*(.*?)\r?$")


def _fields(head: bytes) -> dict[str, str]:
    return {k.decode("latin-1").lower(): v.decode("utf-8", "surrogateescape") for k, v in _HEAD.findall(head)}


def _parts(batches):
    """(file, split's start, [texts between magics]) for each split, in order. The text before a split's first magic is part 0."""
    now, held = None, []
    for batch in batches:
        for file, start, value in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, start) != now:
                if now:
                    yield *now, held
                now, held = (file, start), []
            held.append(value)
    if now:
        yield *now, held


def _candidates(held: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each part's place in the split, the place of its magic, and its successor (-1: not a record's head).

    Part k is preceded by the (k-1)-th separator, so candidates are parts after the first."""
    n = len(held)
    at = np.concatenate(([0], np.cumsum([len(v) + len(_M) for v in held])))[:n]
    magic, after = at - len(_M), np.full(n, -1, np.int64)
    for k, v in enumerate(held):
        cut = v.find(b"\r\n\r\n")
        size = _fields(v[: cut + 2]).get("content-length", "") if cut >= 0 else ""
        if size.isdigit():
            after[k] = at[k] + cut + 4 + int(size) + len(END)
    return at, magic, after


def _exits(magic: np.ndarray, after: np.ndarray, end: int) -> np.ndarray:
    """Where the chain from each candidate leaves the split (at or after end), by pointer jumping; -1 where it breaks off."""
    where = {int(m): k for k, m in enumerate(magic)}
    n = len(magic)
    hop = np.array([where.get(int(a), n) if a >= 0 else n for a in after] + [n], np.int64)
    out = np.append(np.where(after >= end, after, -1), -1)
    out[:n][(hop[:n] == n) & (after < end)] = -1
    done = False
    while not done:
        out = np.where(hop < n, out[hop], out)
        done = bool((hop == hop[hop]).all())
        hop = hop[hop]
    return out[:n]


def _reached(magic: np.ndarray, after: np.ndarray, entry: int | None) -> np.ndarray:
    """Which candidates the chain from `entry` visits, by pointer jumping: each round doubles how far the marks go."""
    n = len(magic)
    where = {int(m): k for k, m in enumerate(magic)}
    marked = np.zeros(n + 1, bool)
    marked[where.get(entry, n)] = True
    hop = np.array([where.get(int(a), n) if a >= 0 else n for a in after] + [n], np.int64)
    while (hop < n).any():
        marked[hop[marked]] = True
        hop = hop[hop]
    return marked[:n]


def scan(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.option("lineSep", MAGIC).text(at).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.col("value").cast("binary").alias("value")
    )


_CHAIN = pa.schema([("file", pa.string()), ("split", pa.int64()), ("length", pa.int64()), ("magic", pa.int64()), ("exit", pa.int64())])


def entries(spark: SparkSession, at: str) -> DataFrame:
    """file, split, entry: where in the split, counted from its first part, the first record begins (null: none does)."""

    def chains(batches):
        for file, split, held in _parts(batches):
            at, magic, after = _candidates(held)
            length = int(at[-1] + len(held[-1]) + len(_M))
            out = _exits(magic, after, length - len(_M))
            ok = np.flatnonzero(after >= 0)
            n = len(ok) + 1  # and a row for the split itself
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(([file] * n, [split] * n, [length] * n, [None, *magic[ok].tolist()], [None, *out[ok].tolist()]), _CHAIN.types)],
                schema=_CHAIN
            )

    found = materialise(scan(spark, at).mapInArrow(chains, "file string, split long, length long, magic long, exit long"), "chains")
    splits = found.filter("magic is null").select("file", "split", "length")
    most = splits.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    splits = splits.select("file", "split", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("base"))
    jump = found.filter("magic is not null").join(splits, ["file", "split"]).select(
        "file", "split", "base", (F.col("magic") + F.col("base")).alias("from"),
        F.when(F.col("exit") >= 0, F.col("exit") + F.col("base")).alias("to")
    )
    jump = known = materialise(jump, "jump")
    reached = splits.select("file").distinct().withColumn("from", F.lit(0).cast("long"))
    steps = 1
    while steps < most:
        further = reached.join(jump.filter("to is not null"), ["file", "from"]).select("file", F.col("to").alias("from"))
        reached = materialise(reached.union(further).distinct(), "reached")
        steps *= 2
        if steps < most:
            far = jump.select("file", F.col("from").alias("to"), F.col("to").alias("further"))
            jump = materialise(jump.join(far, ["file", "to"]).select("file", "from", F.col("further").alias("to")), "jump")
    first = known.join(reached, ["file", "from"], "left_semi").groupBy("file", "split").agg(F.min(F.col("from") - F.col("base")).alias("entry"))
    return splits.select("file", "split").join(first, ["file", "split"], "left")


_FOUND = "file string, split long, lead binary, page_id long, url string, type string, refers_to long, size long, digest string, payload binary, missing long"
_FOUND_ARROW = pa.schema(
    [
        ("file", pa.string()), ("split", pa.int64()), ("lead", pa.binary()), ("page_id", pa.int64()), ("url", pa.string()),
        ("type", pa.string()), ("refers_to", pa.int64()), ("size", pa.int64()), ("digest", pa.string()), ("payload", pa.binary()),
        ("missing", pa.int64())
    ]
)


def _number(name: str):
    digits = name.strip("<>").rpartition(":")[2]
    return int(digits) if re.fullmatch(r"-?\d+", digits) else None


def _record(head: bytes, block: bytes, missing: int, keep: bool) -> tuple:
    """The columns of one record; while bytes are missing it keeps its block, and its head in url."""
    f = _fields(head)
    revisit = f.get("warc-type") == "revisit"
    if missing:
        return _number(f.get("warc-record-id", "")), f.get("warc-target-uri", ""), "revisit" if revisit else "response", None, None, None, block, missing
    size = int(f.get("x-payload-length", "0")) if revisit else len(block)
    digest = f.get("warc-payload-digest", "").rpartition(":")[2] if revisit else hashlib.sha1(block).hexdigest()
    return _number(f.get("warc-record-id", "")), f.get("warc-target-uri", ""), "revisit" if revisit else "response", _number(f.get("warc-refers-to", "")) if revisit else None, size, digest, block if keep else None, 0


def read(spark: SparkSession, at: str, payloads: bool = True) -> DataFrame:
    """page_id, url, type, refers_to, size, digest and (null if not asked for) payload of every record in the archives at `at`.

    A response's size and digest are taken of what was read; a revisit's are those of its head."""
    known = entries(spark, at)
    parts, entry_of = scan(spark, at), None
    size = known.agg(F.sum(F.octet_length("file") + 100)).first()[0] or 0  # a name and two numbers for each split
    if size <= BROADCAST_BYTES:
        entry_of = spark.sparkContext.broadcast({(r["file"], r["split"]): r["entry"] for r in known.collect()})
    else:
        parts = parts.withColumn("seq", F.monotonically_increasing_id()).join(known, ["file", "split"], "left")
        parts = parts.repartition(fan_out(spark), "file", "split").sortWithinPartitions("file", "split", "seq")
        mark = F.concat(F.coalesce(F.col("entry"), F.lit(-1)).cast("string"), F.lit(" ")).cast("binary")
        parts = parts.select("file", "split", F.concat(mark, "value").alias("value"))

    def found(batches):
        for file, split, held in _parts(batches):
            if entry_of is not None:
                entry = entry_of.value[file, split]
            else:
                entry = int(held[0].split(b" ", 1)[0])
                entry, held = None if entry == -1 else entry, [v.split(b" ", 1)[1] for v in held]
            at, magic, after = _candidates(held)
            where = {int(m): k for k, m in enumerate(magic)}
            on = np.flatnonzero(_reached(magic, after, entry)).tolist()
            first = on[0] if on else len(held)
            rows, size = [], 0
            lead = _M.join(held[:first])
            if split and first:  # what the last record of an earlier split goes on with
                rows.append((file, split, _M + lead, None, None, None, None, None, None, None, None))
            for k in on:
                if after[k] < 0:  # no record's head: the chain breaks off here
                    break
                n = where.get(int(after[k]), len(held))
                whole = held[k] if n == k + 1 else _M.join(held[k:n])
                cut = whole.find(b"\r\n\r\n")
                want = int(after[k]) - int(at[k]) - cut - 4 - len(END)
                block = whole[cut + 4 : cut + 4 + want]
                missing = want - len(block)
                rows.append((file, split, None, *_record(whole[: cut + 2], block, missing, payloads)))
                size += len(block)
                if size > 1 << 22 or len(rows) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _FOUND_ARROW.types)], schema=_FOUND_ARROW)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _FOUND_ARROW.types)], schema=_FOUND_ARROW)

    df = parts.mapInArrow(found, _FOUND)
    out = ("page_id", "url", "type", "refers_to", "size", "digest", "payload")
    if not known.groupBy("file").count().filter("count > 1").limit(1).count():
        return df.select(*out)  # no record goes on in another split
    df = materialise(df, "records")

    def stitched(batches):
        """Records that go on beyond their split: `missing` bytes come from the leads of the splits after it."""
        open_, got = None, b""
        for batch in batches:
            for row in batch.to_pylist():
                if row["lead"] is None:
                    open_, got = row, row["payload"]
                    continue
                if open_ is None or open_["file"] != row["file"]:
                    continue
                more = row["lead"][: open_["missing"]]
                got += more
                open_["missing"] -= len(more)
                if open_["missing"] == 0:
                    done = open_ | {"payload": got if payloads else None, "size": len(got), "digest": hashlib.sha1(got).hexdigest()}
                    yield pa.RecordBatch.from_pylist([{k: done[k] for k in out}], schema=pa.schema([f for f in _FOUND_ARROW if f.name in out]))
                    open_ = None

    torn = df.filter("lead is not null or missing > 0").repartition(fan_out(spark), "file").sortWithinPartitions("file", "split", F.col("lead").isNull())
    schema = "page_id long, url string, type string, refers_to long, size long, digest string, payload binary"
    whole = df.filter("lead is null and missing = 0").select(*out)
    return whole.unionByName(torn.select(*_FOUND_ARROW.names).mapInArrow(stitched, schema).select(*out))


def op4_warc(spark, sf_dir: str) -> DataFrame:
    at = f"{shared_dir(spark)}/barloom/warc-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), at)
    return read(spark, at, payloads=False).select(
        "page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"),
        "refers_to", "url"
    )


#: What must come back, in SQL: the archives themselves have no place in it.
OP4_SQL = """WITH p AS (SELECT page_id, replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') AS url, encode(coalesce(html, '')) AS b FROM pages),
 d AS (SELECT page_id, url, octet_length(b) AS n, sha1(b) AS h FROM p), f AS (SELECT h, max(page_id) AS m FROM d WHERE n >= 1000 GROUP BY 1)
 SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.h AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN again THEN m END AS refers_to, url FROM (SELECT d.*, m, n >= 1000 AND m IS NOT NULL AND (page_id IS NULL OR page_id < m) AS again FROM d LEFT JOIN f ON d.h = f.h) d"""
