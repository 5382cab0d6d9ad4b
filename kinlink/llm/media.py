"""Interleaved document sequences with content-addressed media.

HTML becomes one ordered sequence of items: text runs and media references with their captions, each at its position.
A reference is a digest (`sha256:<hex>`) or a name that a manifest maps to one; joins on digests resolve references
against a media store that holds the stored form of each payload. The store's format is a binary 8-bit grey map (PGM, 64
samples a row), so any byte string that is padded to a multiple of 64 is kept losslessly. A reference may state the
payload's length before padding (`data-length`), which stays with the reference.

Payload bytes are written where they are read and never shuffled: each task stores what it has not stored yet, a digest
may so be held by several tasks, and digests are made unique on the small feature rows. References travel grouped by
digest within each task, so a payload that a third of all documents share is a handful of rows in the join. Text items
are never joined.

Defined results: null or empty text is a payload of 64 zero bytes; null html is an empty sequence; references without a
stored payload, and names that no manifest knows, keep their position and caption with null media; equal payloads get
equal values; repeated rows are repeated; rows with a null id are kept; an empty table gives an empty result; extra
columns are never read.
"""

from __future__ import annotations

import hashlib
import html
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm.common import scratch_path, sliced, text_table, trim

ROW = 64
ITEM_SQL = "position:int,kind:string,text:string,ref:string,caption:string,length:bigint"
SEQUENCE_SQL = f"array<struct<{ITEM_SQL}>>"
_ITEM = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string()), ("length", pa.int64())]))
FEATURES_SQL = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
#: Rows that are turned into pages, items or payloads at a time.
SLICE = 1024
#: References to one digest leave a task in lists of at most this many.
GROUP = 4096


class _Sequence(HTMLParser):
    """Text runs between block elements, and media elements; a figure's caption belongs to its last medium."""

    MEDIA = {"img", "video", "audio", "embed", "source"}
    INLINE = {"a", "b", "i", "em", "strong", "span", "u", "small", "sub", "sup", "code"}
    HIDDEN = {"script", "style", "template", "noscript"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.caption: list[str] | None = None
        self.hidden = 0

    def _flush(self):
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self._add("text", text, None, None)

    def _add(self, kind, text, ref, caption, length=None):
        self.items.append({"position": len(self.items), "kind": kind, "text": text, "ref": ref, "caption": caption, "length": length})

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag == "figcaption":
            self._flush()
            self.caption = []
        elif tag in self.MEDIA:
            self._flush()
            found = dict(attrs)
            if found.get("src"):
                length = found.get("data-length") or ""
                self._add("media", None, found["src"], found.get("alt") or found.get("title"), int(length) if length.isascii() and length.isdigit() and len(length) < 19 else None)
        elif tag not in self.INLINE:
            self._flush()

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            text, self.caption = " ".join("".join(self.caption).split()), None
            if text and self.items and self.items[-1]["kind"] == "media":
                self.items[-1]["caption"] = text
            elif text:
                self._add("text", text, None, None)
        elif tag not in self.INLINE:
            self._flush()

    def handle_data(self, data):
        if not self.hidden:
            (self.run if self.caption is None else self.caption).append(data)

    def close(self):
        super().close()
        self._flush()
        return self.items


def sequence_of(page: str | None) -> list[dict]:
    parser = _Sequence()
    parser.feed(page or "")
    return parser.close()


def sequences(pages: DataFrame, key: str, page: str = "html") -> DataFrame:
    """key, items: each page's ordered text and media items."""

    def run(batches):
        for b in sliced(batches, SLICE):
            yield pa.record_batch([b.column(0), pa.array([sequence_of(x) for x in b.column(1).to_pylist()], _ITEM)], names=[key, "items"])
        trim()

    return pages.select(F.col(key).cast("long").alias(key), F.col(page).cast("string").alias("_page")).mapInArrow(run, f"{key} long, items {SEQUENCE_SQL}")


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8")
    return raw + bytes(max(ROW, -(-len(raw) // ROW) * ROW) - len(raw))


def encode_media(payload: bytes) -> bytes:
    return b"P5 %d %d 255\n" % (ROW, len(payload) // ROW) + payload


def decode_media(media: bytes) -> bytes:
    head, _, samples = media.partition(b"\n")
    kind, width, height, top = head.split()
    if kind != b"P5" or top != b"255" or int(width) * int(height) != len(samples):
        raise ValueError("not an 8-bit grey map")
    return samples


def write_store(docs: DataFrame, path: str) -> None:
    """The payload of every text under its digest; within a task each digest once."""

    def run(batches):
        seen: set[bytes] = set()
        for b in sliced(batches, SLICE):
            out = []
            for text in b.column("text").to_pylist():
                payload = payload_of(text)
                digest = hashlib.sha256(payload)
                if digest.digest() not in seen:
                    if len(seen) >= 1 << 18:
                        seen.clear()
                    seen.add(digest.digest())
                    out.append((digest.hexdigest(), encode_media(payload)))
            yield pa.record_batch([pa.array([x[k] for x in out], t) for k, t in ((0, pa.string()), (1, pa.binary()))], names=["digest", "media"])
        trim()

    text_table(docs).select("text").mapInArrow(run, "digest string, media binary").write.mode("overwrite").option("compression", "zstd").parquet(path)


def _features(samples: bytes) -> str:
    """Mean and deviation of the samples, and the strongest change between rows."""
    x = np.frombuffer(samples, np.uint8).reshape(-1, ROW)
    rows = x.mean(1)
    step = float(np.abs(np.diff(rows)).max()) if len(rows) > 1 else 0.0
    return f"mean={x.mean():.6f};std={x.std():.6f};step={step:.6f}"


def stored_features(spark: SparkSession, path: str) -> DataFrame:
    """One row for each digest, from the stored bytes as read back; a payload that fails its digest is an error."""

    def run(batches):
        for b in sliced(batches, SLICE):
            out = []
            for digest, media in zip(*(b.column(c).to_pylist() for c in ("digest", "media"))):
                samples = decode_media(media)
                found = hashlib.sha256(samples).hexdigest()
                if found != digest:
                    raise ValueError(f"payload under {digest} has digest {found}")
                out.append((digest, len(samples), found, zlib.crc32(samples[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), _features(samples)))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in FEATURES_SQL.split(", ")])

    rows = spark.read.parquet(path).mapInArrow(run, FEATURES_SQL)
    return rows.groupBy("digest").agg(*[F.min(c).alias(c) for c in rows.columns if c != "digest"])


def document_pages(docs: DataFrame) -> DataFrame:
    """Each document as a page of its paragraphs and a figure that refers to its payload: doc_id, html."""

    def run(batches):
        for b in sliced(batches, SLICE):
            pages = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                text = text or ""
                body = "".join(f"<p>{html.escape(x)}</p>" for x in text.split("\n\n"))
                figure = f'<img src="sha256:{hashlib.sha256(payload_of(text)).hexdigest()}" data-length="{len(text.encode("utf-8"))}"><figcaption>Document {doc_id}</figcaption>'
                pages.append(f"<article>{body}<figure>{figure}</figure></article>")
            yield pa.record_batch([b.column("doc_id"), pa.array(pages, pa.string())], names=["doc_id", "html"])
        trim()

    return text_table(docs).mapInArrow(run, "doc_id long, html string")


def grouped_references(items: DataFrame, key: str) -> DataFrame:
    """ref, holders: the (key, position, caption, length) that refer to it, gathered within each task."""
    kind = pa.list_(pa.struct([("key", pa.int64()), ("position", pa.int32()), ("caption", pa.string()), ("length", pa.int64())]))

    def run(batches):
        held: dict[str, list] = {}
        rows = 0

        def out():
            flat = [(k, v[i : i + GROUP]) for k, v in held.items() for i in range(0, len(v), GROUP)]
            return pa.record_batch([pa.array([k for k, _ in flat], pa.string()), pa.array([v for _, v in flat], kind)], names=["ref", "holders"])

        for b in batches:
            for k, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for x in found or ():
                    if x["kind"] == "media":
                        held.setdefault(x["ref"], []).append({"key": k, "position": x["position"], "caption": x["caption"], "length": x["length"]})
                        rows += 1
            if rows >= 1 << 17:
                yield out()
                held, rows = {}, 0
        yield out()

    return items.select(key, "items").mapInArrow(run, "ref string, holders array<struct<key:long,position:int,caption:string,length:long>>")


def resolve(items: DataFrame, features: DataFrame, key: str = "doc_id", manifest: DataFrame | None = None) -> DataFrame:
    """key, position, kind, text, ref, caption, length and the media columns: every item of every page, a row each. manifest:
    ref, digest, one row for each ref."""
    media = [c for c in features.columns if c != "digest"]
    refs = grouped_references(items, key)
    named = F.when(F.col("ref").startswith("sha256:"), F.substr("ref", F.lit(8)))
    if manifest is None:
        refs = refs.withColumn("digest", named)
    else:
        known = manifest.select(F.col("ref").alias("_ref"), F.col("digest").alias("_digest"))
        refs = refs.join(known, F.col("ref") == F.col("_ref"), "left").withColumn("digest", F.coalesce(named, "_digest"))
    found = refs.join(features, "digest", "left").select(F.explode("holders").alias("h"), "ref", *media)
    resolved = found.select(F.col("h.key").alias(key), F.col("h.position").alias("position"), F.lit("media").alias("kind"), F.lit(None).cast("string").alias("text"), "ref", F.col("h.caption").alias("caption"), F.col("h.length").alias("length"), *media)
    texts = items.select(key, F.explode("items").alias("x")).where("x.kind = 'text'").select(key, "x.position", F.lit("text").alias("kind"), "x.text", *[F.lit(None).cast(resolved.schema[c].dataType).alias(c) for c in ("ref", "caption", "length", *media)])
    return resolved.unionByName(texts)


def interleaved(resolved: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, items: each page's resolved items in order, put together again. Repeated keys give one sequence."""
    rest = [c for c in resolved.columns if c not in (key, "position")]
    return resolved.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", *rest))).alias("items"))


def document_media(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, position, caption and the media columns of every document's stored payload."""
    path = scratch_path(spark, "media")
    write_store(docs, path)
    found = resolve(sequences(document_pages(docs), "doc_id"), stored_features(spark, path))
    return found.where("kind = 'media'").withColumnRenamed("length", "n_bytes").drop("kind", "text", "ref")
