"""The portable archive: a ZIP with manifest.json, catalogue.json, content.json and optionally embeddings.bin.

Rows become JSON with Spark's own functions; only zipping and unzipping is done in batches of bytes.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark import schema
from foliospark.errors import ArchiveReadError
from foliospark.functions import text

VERSION = "1.0"
PRODUCER = "foliospark"
PARTS = ("manifest.json", "catalogue.json", "content.json")


def _json(struct):
    return F.to_json(struct, {"ignoreNullFields": "false"})


def parts(documents: DataFrame, sections: DataFrame, numbers: DataFrame, keep_full_source: bool = False, embeddings: DataFrame | None = None) -> DataFrame:
    """(doc_id, manifest, catalogue, content, embeddings): the archive's entries of each document.

    documents: (doc_id, title, source, format, summary, insights, meta, created_at); sections: (doc_id, sec_idx, id,
    title, level, text, tables, images, parent_id, children, summary, keywords, token_count); numbers: (doc_id, kn_idx,
    label, value, unit, section); embeddings: (doc_id, sec_idx, bytes, model, dims, quantization). A document is one
    archive, so its sections meet in one task.
    """
    index = F.struct("id", "title", "level", "parent_id", "children", F.coalesce("summary", F.lit("")).alias("summary"), "keywords", "token_count")
    body = F.struct("title", "level", "text", "tables", "images")
    ordered = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sec_idx", "id", index.alias("index"), body.alias("body")))).alias("s"))
    listed = numbers.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("kn_idx", "label", "value", "unit", "section"))), lambda x: F.struct(x["label"].alias("label"), x["value"].alias("value"), x["unit"].alias("unit"), x["section"].alias("section"))).alias("key_numbers"))
    rows = documents.join(ordered.withColumnRenamed("doc_id", "d1_"), F.expr("doc_id = d1_"), "left").join(listed.withColumnRenamed("doc_id", "d2_"), F.expr("doc_id = d2_"), "left").drop("d1_", "d2_")
    if embeddings is None:
        rows = rows.withColumn("vectors", F.lit(None).cast("array<binary>")).withColumn("model", F.lit("")).withColumn("dims", F.lit(0)).withColumn("quantization", F.lit("float16"))
    else:
        blocks = embeddings.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sec_idx", "bytes"))), lambda x: x["bytes"]).alias("vectors"), F.first("model").alias("model"), F.first("dims").alias("dims"), F.first("quantization").alias("quantization"))
        rows = rows.join(blocks.withColumnRenamed("doc_id", "d3_"), F.expr("doc_id = d3_"), "left").drop("d3_")
        rows = rows.withColumn("model", F.coalesce("model", F.lit(""))).withColumn("dims", F.coalesce("dims", F.lit(0))).withColumn("quantization", F.coalesce("quantization", F.lit("float16")))
    none = F.array().cast("array<string>")
    meta = [F.coalesce("meta.owner", F.lit("")).alias("owner"), F.coalesce("meta.department", F.lit("")).alias("department"), F.coalesce("meta.tags", none).alias("tags"),
            F.coalesce("meta.access_roles", F.array(F.lit("*"))).alias("access_roles"), F.coalesce("meta.version", F.lit("1.0")).alias("version"), F.coalesce("meta.last_updated", F.lit("")).alias("last_updated")]
    model = [F.col("model").alias("embedding_model"), F.col("dims").cast("int").alias("embedding_dims"), "quantization"]
    manifest = F.struct(F.lit(VERSION).alias("udf_version"), "doc_id", "title", F.col("format").alias("source_format"), "created_at", *model, F.coalesce(F.size("s"), F.lit(0)).alias("section_count"),
                        F.lit(True).alias("intelligence"), F.lit("binary").alias("embedding_format"), *meta, F.lit(PRODUCER).alias("producer"))
    empty = F.from_json(F.lit("[]"), f"array<{schema.KEY_NUMBER_WIRE}>")
    catalogue = F.struct("doc_id", "title", text.source_label(F.col("source"), keep_full_source).alias("source"), F.lit("en").alias("language"), F.coalesce("summary", F.lit("")).alias("summary"),
                         F.coalesce("insights", none).alias("insights"), *meta, F.coalesce("key_numbers", empty).alias("key_numbers"), F.coalesce(F.transform("s", lambda x: x["index"]), F.array()).alias("section_index"), *model)
    content = F.struct("doc_id", F.map_from_entries(F.transform("s", lambda x: F.struct(x["id"], x["body"]))).alias("sections"))
    return rows.select("doc_id", _json(manifest).alias("manifest"), _json(catalogue).alias("catalogue"), _json(content).alias("content"), F.col("vectors"))


def pack(entries: DataFrame) -> DataFrame:
    """(doc_id, archive): the ZIP's bytes. JSON is deflated as far as it goes, embeddings are stored."""

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w") as z:
                    for name, value in zip(PARTS, (r.manifest, r.catalogue, r.content)):
                        z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), value, zipfile.ZIP_DEFLATED, 9)
                    if r.vectors is not None and len(r.vectors):
                        z.writestr(zipfile.ZipInfo("embeddings.bin", (1980, 1, 1, 0, 0, 0)), b"".join(r.vectors), zipfile.ZIP_STORED)
                out.append((r.doc_id, buffer.getvalue()))
            yield pd.DataFrame(out, columns=["doc_id", "archive"])

    return entries.mapInPandas(run, "doc_id string, archive binary")


def write(archives: DataFrame, folder: str) -> None:
    """One <doc_id>.udf file per row, written by the executors. On a cluster the folder must be mounted on all of them.

    Each file is written whole and then renamed, so a repeated task replaces it and leaves no half file. Where there is
    no such mount, keep the table of archives itself: `pack(...).write.parquet(...)`.
    """
    import os

    def one(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            part = f"{folder}/.{r.doc_id}.{os.getpid()}"
            with open(part, "wb") as f:
                f.write(r.archive)
            os.replace(part, f"{folder}/{r.doc_id}.udf")

    archives.foreachPartition(one)


def unpack(files: DataFrame) -> DataFrame:
    """(path, manifest, catalogue, content, embeddings, error) of (path, content) rows, the JSON parts as structs."""

    def run(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    out.append((path, *_entries(path, content), None))
                except ArchiveReadError as e:
                    out.append((path, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "manifest", "catalogue", "content", "embeddings", "error"])

    raw = files.select("path", "content").mapInPandas(run, "path string, manifest string, catalogue string, content string, embeddings binary, error string")
    read = raw.select("path", F.from_json("manifest", schema.MANIFEST).alias("manifest"), F.from_json("catalogue", schema.CATALOGUE).alias("catalogue"), F.from_json("content", schema.CONTENT).alias("content"), "embeddings", "error")
    other = F.col("error").isNull() & (F.coalesce(F.col("manifest.udf_version"), F.lit("")) != VERSION)
    return read.withColumn("error", F.when(other, F.concat(F.lit("unsupported version "), F.coalesce("manifest.udf_version", F.lit("(none)")))).otherwise(F.col("error")))


def _entries(path: str, content: bytes) -> tuple:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            there = set(z.namelist())
            if missing := [p for p in PARTS if p not in there]:
                raise ArchiveReadError(f"{path} lacks {', '.join(missing)}")
            return (*(z.read(p).decode() for p in PARTS), z.read("embeddings.bin") if "embeddings.bin" in there else None)
    except zipfile.BadZipFile as e:
        raise ArchiveReadError(f"{path}: {e}") from e


def sections_of(archives: DataFrame) -> DataFrame:
    """Section rows of unpacked archives: the index joined with the contents by id; missing contents are empty."""
    rows = archives.filter("error IS NULL").select(F.col("manifest.doc_id").alias("doc_id"), F.posexplode("catalogue.section_index").alias("sec_idx", "i"), F.col("content.sections").alias("m"))
    body = F.try_element_at("m", F.col("i.id"))
    return rows.select(
        "doc_id", "sec_idx", "i.id", "i.title", "i.level", F.coalesce(body["text"], F.lit("")).alias("text"), F.coalesce(body["tables"], F.array()).alias("tables"), F.coalesce(body["images"], F.array()).alias("images"),
        "i.parent_id", F.coalesce("i.children", F.array()).alias("children"), F.nullif(F.col("i.summary"), F.lit("")).alias("summary"), F.coalesce("i.keywords", F.array()).alias("keywords"), F.coalesce("i.token_count", F.lit(0)).alias("token_count"),
    )


def documents_of(archives: DataFrame) -> DataFrame:
    meta = F.struct(*[F.col(f"catalogue.{c}") for c in ("owner", "department", "tags", "access_roles", "version", "last_updated")])
    return archives.filter("error IS NULL").select("manifest.doc_id", "manifest.title", "catalogue.source", F.col("manifest.source_format").alias("format"), F.nullif(F.col("catalogue.summary"), F.lit("")).alias("summary"), "catalogue.insights", "catalogue.key_numbers", meta.alias("meta"))


def info(archives: DataFrame) -> DataFrame:
    """What the command line shows of an archive."""
    return archives.filter("error IS NULL").select("path", "manifest.title", F.col("manifest.source_format").alias("format"), F.col("manifest.udf_version").alias("version"), F.size("catalogue.section_index").alias("n_sections"), F.size("catalogue.key_numbers").alias("n_key_numbers"), "catalogue.summary")
