r"""Secret scans over a ledger of content-addressed blobs.

A version is a row (path, text); its blob is the SHA-256 of the text.  The ledger remembers the
(blob, rule, rule version) triples that were scanned and their findings, so a run scans only the
triples it hasn't seen and joins all findings back to every path that ever had the blob.

Each rule names literal anchors without which it can't match.  The ledger is asked first, by the hash; whether an
unseen text holds an anchor is decided by one pass of an automaton over the Arrow column while the table is read; only texts
that hold one are moved and scanned, whole, so that the shuffle is a small part of the input.  Ledger entries of a run go
to a folder of its own and its scanned triples are written last: a run that dies leaves
nothing that counts.

Cases: a null text has no blob and no findings; an empty one has a blob without findings; a very long one is scanned whole; null
paths and ids stay null in the findings, and an id that is no whole number counts as null; repeated rows are paths of one blob,
each reported; findings of different rules may overlap, and ``redact`` masks the first, or of equal starts the longest, and what the
others have beyond it; columns with clashing names stay as they are; an empty table gives no findings.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from engramite.llm.common import ROW, col, exists, ident, is_small, packed, shared_dir, spread, string, unpacked, written
from engramite.llm.textops import slices


@dataclass(frozen=True)
class Rule:
    """``pattern`` means the same to Python's and RE2's engines; ``anchors`` are lower case, one of them is in any match."""

    name: str
    version: int
    pattern: str
    anchors: tuple[str, ...]

    @property
    def tag(self) -> str:
        return f"{self.name}@{self.version}"


RULES = (
    Rule("assigned_secret", 1, r"""(?i:token|secret|passw(?:or)?d|api[_-]?key)["']?[ \t]*[:=][ \t]*(?:["'][0-9A-Za-z_/+=.-]{16,}["']|[A-Za-z_-]{0,16}[0-9][0-9A-Za-z_/+=-]{11,})""", ("token", "secret", "passw", "api_key", "api-key", "apikey")),
    Rule("aws_access_key", 1, r"AKIA[0-9A-Z]{16}", ("akia",)),
    Rule("github_token", 1, r"gh[pousr]_[0-9A-Za-z]{36}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("github_fine_grained_token", 1, r"github_pat_[0-9A-Za-z]{22}_[0-9A-Za-z]{59}", ("github_pat_",)),
    Rule("slack_token", 1, r"xox[abprs]-[0-9A-Za-z-]{10,}", ("xox",)),
    Rule("google_api_key", 1, r"AIza[0-9A-Za-z_-]{35}", ("aiza",)),
    Rule("stripe_key", 1, r"sk_live_[0-9A-Za-z]{16,}", ("sk_live_",)),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", ("-----begin",)),
    Rule("json_web_token", 1, r"eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}", ("eyj",)),
    Rule("url_password", 2, r"[A-Za-z][0-9A-Za-z+.-]*://[^ \t\r\n/:@]+:[^ \t\r\n/:@]+@", ("://",)),
)

_FINDING = "blob string, rule string, version int, n int, start int, end int, digest string"


def anchored(column: pa.Array, rules: tuple[Rule, ...] = RULES) -> pa.Array:
    """Whether any rule can match each text at all; ASCII letters of either case count as their anchors'."""
    any_of = "|".join(re.escape(a) for a in dict.fromkeys(a for r in rules for a in r.anchors))
    return pc.fill_null(pc.match_substring_regex(column, f"(?i:{any_of})"), False)


def blob(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _screen(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    """Keeps each unseen text only where it has an anchor; the texts of known blobs aren't looked at."""
    for part in slices(batches, "text"):
        text, known = part.column("text"), part.column("known").to_numpy(zero_copy_only=False)
        hot = np.zeros(len(text), dtype=bool)
        hot[~known] = anchored(text.filter(pa.array(~known)), rules).to_numpy(zero_copy_only=False)
        kept = text.take(pa.array(np.arange(len(text)), mask=~hot))
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "path", "blob")), kept, part.column("known")], names=["doc_id", "path", "blob", "text", "known"])


def _split(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...], hot: bool) -> Iterator[pa.RecordBatch]:
    """The packed rows whose text has an anchor, with their blobs, or the others."""
    for part in slices(batches, "t"):
        found = anchored(part.column("t"), rules)
        part = part.filter(found if hot else pc.invert(found))
        if hot:
            part = part.append_column("blob", pa.array(map(blob, part.column("t").to_pylist()), pa.string()))
        yield part if hot else part.select([ROW])


def _scan(rules: tuple[Rule, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    compiled = {r.tag: (r, re.compile(r.pattern)) for r in rules}
    for batch in batches:
        rows: list[tuple] = []
        for sha, text, tags in zip(batch.column("blob").to_pylist(), batch.column("text").to_pylist(), batch.column("pending").to_pylist(), strict=True):
            for tag in tags:
                rule, pattern = compiled[tag]
                for n, m in enumerate(pattern.finditer(text), 1):
                    rows.append((sha, rule.name, rule.version, n, m.start(), m.end(), hashlib.sha256(m.group().encode()).hexdigest()))
        names = ["blob", "rule", "version", "n", "start", "end", "digest"]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def _read(df: DataFrame, folder: str, schema: str) -> DataFrame:
    """The tables of all runs; none is there before the first run, and one that can't be read is an error."""
    spark = df.sparkSession
    if not exists(spark, folder):
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])
    return spark.read.schema(schema).parquet(folder)


def complete(df: DataFrame, ledger: str, rules: tuple[Rule, ...]) -> DataFrame | None:
    """The blobs that need no scan by any of the rules; None before the first run."""
    if not exists(df.sparkSession, f"{ledger}/scanned/*"):
        return None
    seen = _read(df, f"{ledger}/scanned/*", "blob string, tags array<string>").select("blob", F.explode("tags").alias("tag")).where(F.col("tag").isin([r.tag for r in rules]))
    return seen.groupBy("blob").agg(F.count_distinct("tag").alias("n")).where(F.col("n") == len(rules)).select("blob")


def update(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Brings the ledger folder up to date with (blob, text) rows and returns all its findings under these rules.

    A null text is a blob without any anchor: it needs no scan but is recorded like the others.
    """
    spark = versions.sparkSession
    tags = [r.tag for r in rules]
    seen = _read(versions, f"{ledger}/scanned/*", "blob string, tags array<string>").select("blob", F.explode("tags").alias("tag")).groupBy("blob").agg(F.collect_set("tag").alias("tags"))
    new = versions.groupBy("blob").agg(F.max("text").alias("text")).join(seen, "blob", "left")
    new = new.select("blob", "text", F.array_except(F.array(*map(F.lit, tags)), F.coalesce("tags", F.array().cast("array<string>"))).alias("pending")).where(F.size("pending") > 0)
    new = written(new)
    run = uuid.uuid4().hex
    new.where("text IS NOT NULL").mapInArrow(lambda batches: _scan(rules, batches), _FINDING).write.parquet(f"{ledger}/findings/{run}")
    new.select("blob", F.col("pending").alias("tags"), F.lit(run).alias("run")).write.parquet(f"{ledger}/scanned/{run}")
    whole = _read(versions, f"{ledger}/scanned/*", "blob string, tags array<string>, run string").select("run").distinct()
    found = _read(versions, f"{ledger}/findings/*", _FINDING).withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    current = F.struct("rule", "version").isin([F.struct(F.lit(r.name), F.lit(r.version)) for r in rules])
    return found.join(whole, "run", "left_semi").where(current).drop("run").distinct()


def scan(docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", path_col: str = "source", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, path, blob, rule, version, n, start, end, digest): every finding in every row, by character offsets."""
    ledger = ledger or shared_dir(docs.sparkSession)
    rows = spread(docs.select(ident(id_col).alias("doc_id"), string(path_col).alias("path"), string(text_col).alias("text")).where("text IS NOT NULL"))
    rows = rows.withColumn("blob", F.sha2("text", 256))
    # the ledger is asked before any text is looked at
    seen = complete(docs, ledger, rules)
    if seen is None:
        rows = rows.withColumn("known", F.lit(False))
    else:
        seen = written(seen)
        known = seen.select(F.col("blob").alias("b"))
        rows = rows.join(F.broadcast(known) if is_small(known) else known, F.col("blob") == F.col("b"), "left").withColumn("known", F.col("b").isNotNull()).drop("b")
    staged = written(rows.select("doc_id", "path", "blob", "text", "known").mapInArrow(lambda batches: _screen(batches, rules), "doc_id long, path string, blob string, text string, known boolean"))
    return staged.select("doc_id", "path", "blob").join(update(staged.where("NOT known").select("blob", "text"), ledger, rules), "blob").select("doc_id", "path", "blob", "rule", "version", "n", "start", "end", "digest")


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("t").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            if spans:
                at, parts = 0, []
                for s in sorted(spans, key=lambda s: (s["start"], -s["end"], s["rule"])):
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], f"[{s['rule']}]"]
                    at = max(at, s["end"])
                text = "".join(parts) + text[at:]
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(ROW), pa.array(out, pa.string())], names=[ROW, "t"])


def redact(docs: DataFrame, ledger: str | None = None, text_col: str = "text", size_col: str | None = "n_chars", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every finding replaced by its rule's name in brackets and ``size_col`` (if there) set anew; all rows stay.

    Texts without an anchor pass by without a shuffle.
    """
    rows = packed(docs.withColumn(text_col, col(text_col).cast("string")), t=col(text_col).cast("string"))
    plain = rows.mapInArrow(lambda batches: _split(batches, rules, False), rows.select(ROW).schema)
    hot = written(rows.mapInArrow(lambda batches: _split(batches, rules, True), rows.withColumn("blob", F.lit("")).schema))
    found = update(hot.select("blob", F.col("t").alias("text")), ledger or shared_dir(docs.sparkSession), rules)
    spans = found.groupBy("blob").agg(F.collect_list(F.struct("start", "end", "rule")).alias("spans"))
    done = hot.join(spans, "blob", "left").select(ROW, "t", "spans")
    done = done.mapInArrow(_mask, done.select(ROW, "t").schema)
    row = F.col(ROW).withField(f"`{text_col}`", F.col("t"))
    if size_col in docs.columns:
        row = row.withField(f"`{size_col}`", F.length("t").cast(docs.schema[size_col].dataType))
    return unpacked(plain.union(done.select(row.alias(ROW))))


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The same findings by DuckDB: matches by regular expression, offsets by the pieces between them."""
    each = " UNION ALL ".join(
        f"SELECT doc_id, source AS path, text, '{r.name}' AS rule, {r.version} AS version, '{r.pattern.replace("'", "''")}' AS pattern, regexp_extract_all(text, '{r.pattern.replace("'", "''")}') AS m, string_split_regex(text, '{r.pattern.replace("'", "''")}') AS p FROM documents WHERE regexp_matches(text, '{r.pattern.replace("'", "''")}')"
        for r in rules
    )
    return f"""WITH f AS ({each}),
g AS (SELECT *, unnest(generate_series(1, len(m))) AS n FROM f),
o AS (SELECT *, list_sum(list_transform(list_slice(p, 1, n), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(m, 1, n - 1), lambda x: length(x))), 0) AS s FROM g)
SELECT doc_id, path, sha256(text) AS blob, rule, CAST(version AS INTEGER) AS version, CAST(n AS INTEGER) AS n, CAST(s AS INTEGER) AS start, CAST(s + length(m[n]) AS INTEGER) AS "end", sha256(m[n]) AS digest FROM o"""
