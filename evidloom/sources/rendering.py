"""Rendered documents: one ordered file for each name, written row by row, put in its place with a backup of what was there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidloom.sources.sinks import render_targets
from evidloom.sources.tables import cut, forget


def _existing(spark, folder: str) -> DataFrame:
    """Names (template_name) of the documents that a folder holds; their contents aren't read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "template_name string")
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder).select(F.regexp_extract("path", r"([^/]*)\.md$", 1).alias("template_name"))
    return listed.where(~F.col("template_name").endswith(".draft")).select(F.url_decode(F.replace("template_name", F.lit("+"), F.lit("%2B"))).alias("template_name"))


def render(lines: DataFrame, folder: str, policy: str = "backup-and-overwrite") -> DataFrame:
    """Lines (template_name, ord, text) -> template_name, target, action, n_bytes, sha256, stored: the documents are in the folder when this returns.

    Each document's lines come to one task in order (of one ord by their text) and go to its file as they come, so none is held. Files are staged first; then each is
    published: what it overwrites is copied to .bak, and the staged file moved to its place. Both steps may be repeated by another attempt:
    a staged file is replaced, a published one is gone from the stage and left alone. Names are the file's names and must be safe path segments.
    """
    spark, run = lines.sparkSession, uuid.uuid4().hex
    stage = f"{folder.rstrip('/')}/.stage-{run}"
    unsafe = lines.where(~F.col("template_name").rlike(r"^[^/\\:*?\[\]\x00-\x1f]+$") | F.col("template_name").startswith(".") | F.col("template_name").isNull())
    if not unsafe.isEmpty():
        raise ValueError("a document's name is no safe path segment")
    targets = cut(render_targets(lines.select("template_name").distinct(), _existing(spark, folder), policy))

    def staged(batches):
        import hashlib

        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        system, base = fs.FileSystem.from_uri(stage)
        now, out, digest, size, done = None, None, None, 0, []

        def close():
            nonlocal out
            if out is not None:
                out.close()
                system.move(f"{base}/.{now}.{attempt}", f"{base}/{now}.md")
                done.append((now, size, digest.hexdigest()))
                out = None

        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if name != now or out is None:
                    close()
                    system.create_dir(base, recursive=True)
                    now, digest, size = name, hashlib.sha256(), 0
                    out = system.open_output_stream(f"{base}/.{now}.{attempt}", compression=None)
                data = ((text or "") + "\n").encode()
                out.write(data)
                digest.update(data)
                size += len(data)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], k) for i, k in enumerate((pa.string(), pa.int64(), pa.string()))], names=["template_name", "n_bytes", "sha256"])

    ordered = lines.select("template_name", "ord", "text").repartition("template_name").sortWithinPartitions("template_name", "ord", "text").select("template_name", "text")
    written = cut(ordered.mapInArrow(staged, "template_name string, n_bytes bigint, sha256 string"))
    plan = written.join(targets.withColumnRenamed("template_name", "__t"), F.col("template_name") == F.col("__t")).select("template_name", "target", "action", "n_bytes", "sha256")

    def published(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder.rstrip("/"))
        for b in batches:
            for name, target, action in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                here, there = f"{base}/.stage-{run}/{name}.md", f"{base}/{target}"
                if system.get_file_info(here).type == fs.FileType.NotFound:
                    continue
                if action == "backup_and_overwrite" and system.get_file_info(there).type != fs.FileType.NotFound:
                    system.copy_file(there, f"{there}.bak.{run}")
                    system.move(f"{there}.bak.{run}", f"{there}.bak")
                system.move(here, there)
            yield b

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plan.schema.fields)
    out = cut(plan.mapInArrow(published, kinds))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stage)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    forget(written)
    forget(targets)
    return out


def verified_texts(spark, folder: str, ledger: DataFrame, pattern: str = "*.md") -> DataFrame:
    """Files of a folder that stand in a ledger (file_name, size, sha256) -> file_name, text. Names and sizes are compared without opening a file; only those that agree are read, and a file whose digest differs, or that is no UTF-8, gives nothing."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))
    known = ledger.select("file_name", F.col("size").cast("long").alias("size"), "sha256").distinct()
    open_ = listed.join(known, (F.col("name") == F.col("file_name")) & (F.col("length") == F.col("size"))).select("file_name", "path", "sha256")

    def read(batches):
        import hashlib

        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            for name, path, digest in zip(*[c.to_pylist() for c in b.columns], strict=True):
                system, place = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
                with system.open_input_stream(place, compression=None) as f:
                    data = f.read()
                if hashlib.sha256(data).hexdigest() != digest:
                    continue
                try:
                    text = data.decode()
                except UnicodeDecodeError:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([text])], names=["file_name", "text"])

    return open_.mapInArrow(read, "file_name string, text string")
