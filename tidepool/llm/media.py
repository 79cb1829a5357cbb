"""Media columns: interleaved document sequences.

A document's HTML is parsed into ordered segments: text blocks and references to media, each with
its position, a reference with its caption. Payloads live in a store keyed by their digest, as
lossless media files; a join on the digest resolves references, and positions and captions stay
with their segments.

A payload is stored as 8-bit grey samples, a portable graymap (P5) of rows of ``WIDTH`` samples.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, html_template

common.shipped(__name__)

WIDTH = 192
SCHEME = "sha256:"
HEADER = re.compile(rb"P5\n([0-9]+) ([0-9]+)\n255\n")
SOURCE = re.compile(r"\b(src|alt|data)\s*=\s*(?>\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
MEDIA = frozenset("img audio video source embed object".split())
SEGMENT = "array<struct<position: int, kind: string, text: string, ref: string, caption: string>>"
FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def parse(source: str | None) -> list[dict]:
    """Segments of a page in order. kind: text or media. A figure's caption goes to the media in it, else alt."""
    out: list[dict] = []
    text: list[str] = []
    figure: list[int] | None = None
    caption = False
    at, size, source = 0, len(source or ""), source or ""

    def flush() -> None:
        line = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if not line:
            return
        if caption and figure:
            for i in figure:
                out[i]["caption"] = line
        else:
            out.append({"position": len(out), "kind": "text", "text": line, "ref": None, "caption": None})

    while at < size:
        m = html_template.TAG.match(source, at)
        at = m.end()
        if m[4] is not None:
            text.append(m[4])
            continue
        if m[2] is None:
            continue
        name = m[2].lower()
        if name in html_template.INLINE and name not in MEDIA:
            continue
        flush()
        if name in html_template.RAW and not m[1]:
            at = html_template.RAW[name].search(source, at).end()
        elif name == "figure":
            figure = None if m[1] else []
        elif name == "figcaption":
            caption = not m[1]
        elif name in MEDIA and not m[1]:
            found = {a[1].lower(): html.unescape(a[2] or a[3] or a[4] or "") for a in SOURCE.finditer(m[3] or "")}
            ref = found.get("src") or found.get("data")
            if ref:
                if figure is not None:
                    figure.append(len(out))
                out.append({"position": len(out), "kind": "media", "text": None, "ref": ref, "caption": found.get("alt")})
    flush()
    return out


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, segments) for each row of pages; null and empty pages have none.

    Very long pages are parsed whole, in one pass. Repeated rows give repeated rows, ids may be
    null, an empty table gives an empty one, and other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([parse(t) for t in b.column(1).to_pylist()], kind)], ["id", "segments"])

    return common.map_texts(pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")), run, f"id {common.type_of(pages, id_col)}, segments {SEGMENT}")


def payload(text_col: str = "text"):
    """UTF-8 bytes, filled with spaces to a positive multiple of WIDTH."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    fill = F.pmod(-F.octet_length(raw), F.lit(WIDTH)) + F.when(F.octet_length(raw) == 0, WIDTH).otherwise(0)
    return F.concat(raw, F.repeat(F.lit(" "), fill).cast("binary"))


def store(df: DataFrame, payload_col: str = "payload") -> tuple[DataFrame, str]:
    """(digest, media), one row for each distinct payload, written to the shared folder and read back; and where.

    Payload lengths are multiples of WIDTH, null payloads aren't stored. The table is the caller's to remove.
    """
    header = F.concat(F.lit(f"P5\n{WIDTH} "), F.expr(f"octet_length({payload_col}) div {WIDTH}").cast("string"), F.lit("\n255\n")).cast("binary")
    rows = df.where(F.col(payload_col).isNotNull()).select(F.sha2(payload_col, 256).alias("digest"), F.concat(header, F.col(payload_col)).alias("media"))
    return common.written(common.once(rows, ["digest"]), "media")


def samples(media: bytes) -> np.ndarray:
    """Rows of samples of a stored graymap."""
    m = HEADER.match(media)
    width, height = int(m[1]), int(m[2])
    return np.frombuffer(media, np.uint8, width * height, m.end()).reshape(height, width)


def describe(stored: DataFrame) -> DataFrame:
    """FEATURES of each row of store(), computed from the stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for digest, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                grid = samples(media)
                raw = grid.tobytes()
                share = np.bincount(grid.ravel(), minlength=256) / grid.size
                entropy = -float((share[share > 0] * np.log2(share[share > 0])).sum())
                feature = f"{grid.shape[1]}x{grid.shape[0]};mean={grid.mean():.4f};deviation={grid.std():.4f};entropy={abs(entropy):.4f};distinct={int((share > 0).sum())}"
                rows.append((digest, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in FEATURES.split(", ")])

    return common.map_texts(stored.select("digest", "media"), run, FEATURES)


def resolve(found: DataFrame, features: DataFrame) -> DataFrame:
    """(id, position, caption, digest, features) for each media segment of sequences(); unknown digests have null features.

    Of the features, one row for each digest, a checkpoint lets Spark split the partition of a
    digest that many documents share. A page that refers to a digest twice has a row for each
    place; empty tables give none.
    """
    refs = found.select("id", F.explode("segments").alias("s")).where("s.kind = 'media'").select("id", "s.position", "s.caption", F.expr(f"if(startswith(s.ref, '{SCHEME}'), substr(s.ref, {len(SCHEME) + 1}), null)").alias("digest"))
    return refs.join(features, "digest", "left")


def page_of(text: str | None, digest: str) -> str:
    """A page with a paragraph for each line and, after the first, the document's payload as a figure captioned with that line."""
    lines = [x for x in (text or "").split("\n") if x.strip()]
    body = [f"<p>{html.escape(x)}</p>" for x in lines]
    body.insert(1, f'<figure><img src="{SCHEME}{digest}" alt="document"><figcaption>{html.escape(lines[0]) if lines else ""}</figcaption></figure>')
    return "<article>" + "".join(body) + "</article>"


def document_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, position, caption, FEATURES) for each row of docs.

    Each text is stored as a payload and referred to from its own page; the page's media segment is
    resolved through the store. Null and empty texts have a payload of spaces. Equal texts share
    digest and features. Ids may be null; repeated rows give repeated rows. An empty table gives
    an empty one. Other columns aren't read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("payload", payload())
    stored, path = store(rows.select("payload"))
    features = common.checkpoint(describe(stored))
    common.removed(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages = [page_of(t, d) for t, d in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pages, pa.string())], ["id", "n_bytes", "html"])

    numbered = rows.select("id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text", F.sha2("payload", 256).alias("digest"))
    pages = common.map_texts(numbered, run, f"id {common.type_of(docs, id_col)}, n_bytes long, html string")
    both = pages.select(F.struct("id", "n_bytes").alias("row"), "html")
    found = resolve(sequences(both, "row", "html"), features)
    return found.select(F.col("id.id").alias("id"), F.col("id.n_bytes").alias("n_bytes"), *[c for c in found.columns if c != "id"])
