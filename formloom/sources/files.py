"""Source files: scan, hash, dedupe, decode to page images."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Accepted suffixes.
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".webp", ".bmp")
HEIC_SUFFIXES = (".heic", ".heif")
PDF_SUFFIXES = (".pdf",)
ACCEPTED = IMAGE_SUFFIXES + HEIC_SUFFIXES + PDF_SUFFIXES


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]+)$", 1))


def accepted(path: Column) -> Column:
    return suffix(path).isin(*ACCEPTED) & ~file_name(path).startswith(".")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, file_hash, doc_id) of the accepted files below a path.
    Only what is selected is read: without content, no bytes leave the reader."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rows = rows.where(accepted(F.col("path"))).select("path", "content", F.sha2("content", 256).alias("file_hash"))
    return rows.withColumn("doc_id", F.substring("file_hash", 1, 12))


#: Suffix -> function from bytes to a list of (width, height, bytes) pages.
Decoder = Callable[[bytes], list[tuple[int, int, bytes]]]


def available_decoders(dpi: int = 200) -> dict[str, Decoder]:
    """Decoders of the libraries that are installed; other formats fail by file."""
    from ..images import png_pages

    out: dict[str, Decoder] = {".png": png_pages}
    try:
        from ..images import image_pages

        out |= dict.fromkeys(IMAGE_SUFFIXES, image_pages())
    except ImportError:
        pass
    try:
        from ..images import heic_pages

        out |= dict.fromkeys(HEIC_SUFFIXES, heic_pages())
    except ImportError:
        pass
    try:
        from ..images import pdf_pages

        out |= dict.fromkeys(PDF_SUFFIXES, pdf_pages(dpi))
    except ImportError:
        pass
    return out


#: Function from a page's bytes to (width, height, bytes, angle) as it is kept.
Prepare = Callable[[bytes], tuple[int, int, bytes, float]]


def decoded(files: DataFrame, decoders: dict[str, Decoder], prepare: Prepare | None = None) -> DataFrame:
    """(path, doc_id, file_hash, page_no, width_px, height_px, image,
    deskew_angle, error): a row for each page, prepared if asked, or one with
    error for a file that cannot be decoded.  No bad file stops a batch."""
    names = ["path", "doc_id", "file_hash", "page_no", "width_px", "height_px", "image", "deskew_angle", "error"]

    def kept(page):
        return prepare(page[2]) if prepare else (*page, 0.0)

    def run(batches):
        for pdf in batches:
            out = []
            for path, doc, digest, content in zip(pdf["path"], pdf["doc_id"], pdf["file_hash"], pdf["content"]):
                end = "." + path.rsplit(".", 1)[-1].lower()
                try:
                    if end not in decoders:
                        raise ValueError(f"no decoder for {end}")
                    pages = [kept(p) for p in decoders[end](bytes(content))]
                    if not pages:
                        raise ValueError("no pages could be rendered")
                    out += [(path, doc, digest, i, *p, None) for i, p in enumerate(pages, 1)]
                except Exception as e:  # noqa: BLE001 - the row reports it
                    out.append((path, doc, digest, None, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=names)

    return files.select("path", "doc_id", "file_hash", "content").mapInPandas(
        run, "path string, doc_id string, file_hash string, page_no int, width_px int, height_px int, image binary, deskew_angle double, error string"
    )


def write_images(rows: DataFrame, root: str) -> DataFrame:
    """Write each row's `image` to `name` below `root` (a path or URI that all
    executors see) and give the rows back without the image.  A file appears
    whole or not at all, and is the same if its task runs again."""
    keep = [f for f in rows.schema.fields if f.name != "image"]

    def run(batches):
        from pyarrow import fs

        place, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        for pdf in batches:
            for name, image in zip(pdf["name"], pdf["image"]):
                path = f"{base.rstrip('/')}/{name}"
                place.create_dir(path.rsplit("/", 1)[0], recursive=True)
                part = f"{path}.{uuid.uuid4().hex}.part"
                with place.open_output_stream(part) as out:
                    out.write(bytes(image))
                place.move(part, path)
            yield pdf.drop(columns="image")

    return rows.mapInPandas(run, StructType(keep))


def with_page_images(pages: DataFrame, root: str) -> DataFrame:
    """Pages with their image written below `root`, and its path."""
    name = F.format_string("%s/page_%04d.png", "doc_id", "page_no")
    rows = write_images(pages.withColumn("name", name), root)
    return rows.withColumn("image_path", F.concat(F.lit(root.rstrip("/") + "/"), "name")).drop("name")


def read_image(path: str) -> bytes:
    from pyarrow import fs

    place, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with place.open_input_stream(inner) as f:
        return f.read()


def ingest(files: DataFrame, documents: DataFrame, decoders: dict[str, Decoder], schema_id: str | None, at: Column, prepare: Prepare | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, pages with images, outcomes) to append.  Known content and repeats within
    the batch are set aside by hash before anything is decoded; a document has
    rows only if all its pages decode."""
    from ..operators.store import new_files

    fresh = new_files(files.select("path", "file_hash"), documents)
    pages = decoded(files.join(fresh, ["path", "file_hash"], "left_semi"), decoders, prepare)
    good = pages.where("error IS NULL")
    docs = good.groupBy("doc_id", "file_hash").agg(F.min("path").alias("source_path"), F.count(F.lit(1)).cast("int").alias("page_count"))
    docs = docs.select("*", F.lit(schema_id).cast("string").alias("schema_id"), at.alias("ingested_at"), F.lit("ingested").alias("status"))
    rows = good.select(F.substring(F.sha2(F.concat_ws(":", "doc_id", "page_no"), 256), 1, 16).alias("page_id"), "doc_id", "page_no", "width_px", "height_px", "image", "deskew_angle")
    bad = pages.where("error IS NOT NULL").select("path", F.lit("failed").alias("outcome"), F.col("error").alias("detail"))
    known = files.select("path", "file_hash").join(fresh, ["path", "file_hash"], "left_anti").select("path", F.lit("duplicate").alias("outcome"), F.lit(None).cast("string").alias("detail"))
    done = docs.select(F.col("source_path").alias("path"), F.lit("ingested").alias("outcome"), F.lit(None).cast("string").alias("detail"))
    return docs, rows, done.unionByName(known).unionByName(bad)
