"""Stored tables: versions of Parquet files, whole or by parts, behind a manifest that is published last."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Store:
    """Tables under one folder. A commit writes new files first and then one manifest; readers follow the newest manifest, so a failed
    write leaves the version before it in force, and lost executors cost only their tasks. Files of older versions are never touched, so these can still be read."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def version(self) -> int:
        """The newest published version, 0 for none."""
        fs, at = self._fs(f"{self.folder}/manifests")
        if not fs.exists(at):
            return 0
        names = [f.getPath().getName() for f in fs.listStatus(at)]
        return max([int(n.removeprefix("v")) for n in names if n.startswith("v")], default=0)

    def _manifest(self, version: int) -> dict[str, dict]:
        """Per table its ``schema``, the columns of its ``part`` and its ``files``: folders and, for a table in parts, the folder of each part in them."""
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.folder}/manifests/v{version}").first()[0]) if version else {}

    def tables(self) -> list[str]:
        return sorted(self._manifest(self.version()))

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """The table as of a version (the newest by default), None if it was never stored. A filter on the columns of its parts leaves other parts' files unread."""
        held = self._manifest(self.version() if version is None else version).get(name)
        if held is None:
            return None
        schema = StructType.fromJson(held["schema"])
        by_base: dict[str, list[str]] = {}
        for base, folder in held["files"]:
            by_base.setdefault(base, []).append(f"{base}/{folder}" if folder else base)
        read = [self.spark.read.schema(schema).option("basePath", base).parquet(*folders).select(*schema.names) for base, folders in by_base.items()]
        return reduce(DataFrame.unionByName, read) if read else self.spark.createDataFrame([], schema)

    def _written(self, name: str, df: DataFrame, part: list[str]) -> list[list[str]]:
        base = f"{self.folder}/data/{name}-{uuid.uuid4().hex}"
        if not part:
            df.write.parquet(base)
            return [[base, ""]]
        df.write.partitionBy(*part).parquet(base)
        fs, at = self._fs(base + "/*=*" * len(part))
        return [[base, "/".join(f.getPath().toString().split("/")[-len(part) :])] for f in fs.globStatus(at)]

    def commit(self, parts: dict[str, tuple[DataFrame, list[str]]] | None = None, **tables: DataFrame) -> int:
        """Store all ``tables`` as one version or none of them; other tables keep their version. Of two that publish the same version at once one fails.

        ``parts`` has tables with the columns that divide them: the parts (combinations of their values) that the rows have take the place of those stored, all
        other parts keep their files. Such a table is in parts from the beginning.
        """
        now = self.version()
        manifest = self._manifest(now)
        for name, df in tables.items():
            manifest[name] = {"schema": df.schema.jsonValue(), "part": [], "files": self._written(name, df, [])}
        for name, (df, part) in (parts or {}).items():
            held = manifest.get(name)
            if held and held["part"] != list(part):
                raise ValueError(f"{name} is stored in parts by {held['part']}, not {part}")
            new = self._written(name, df, list(part))
            kept = [f for f in held["files"] if f[1] not in {p for _, p in new}] if held else []
            manifest[name] = {"schema": held["schema"] if held else df.schema.jsonValue(), "part": list(part), "files": kept + new}
        self._publish(json.dumps(manifest), now + 1)
        return now + 1

    def _publish(self, manifest: str, version: int) -> None:
        """Write the manifest aside, then give it its name in one step that fails if the name is taken: a hard link on a local disk, elsewhere a rename of the file."""
        fs, staged = self._fs(f"{self.folder}/staged-{uuid.uuid4().hex}")
        out = fs.create(staged, False)
        out.write(bytearray(manifest.encode()))
        out.close()
        target = self._fs(f"{self.folder}/manifests/v{version}")[1]
        fs.mkdirs(target.getParent())
        local = fs.getScheme() == "file"
        try:
            if local:
                path = self.spark._jvm.java.io.File
                self.spark._jvm.java.nio.file.Files.createLink(path(target.toUri().getPath()).toPath(), path(staged.toUri().getPath()).toPath())
            elif fs.exists(target) or not fs.rename(staged, target):
                raise RuntimeError(f"version {version} was published meanwhile")
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception):
                raise RuntimeError(f"version {version} was published meanwhile") from error
            raise
        finally:
            if fs.exists(staged):
                fs.delete(staged, False)


def insert_if_absent(held: DataFrame | None, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``held`` and the rows of ``new`` whose key it lacks, of several of one key the first in ``order``."""
    rest = [c for c in new.columns if c not in keys]
    once = new.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
    return once if held is None else held.unionByName(once.join(held.select(*keys), keys, "left_anti"))


def replace_part(held: DataFrame | None, new: DataFrame, part: list[str]) -> DataFrame:
    """``new`` in place of all rows of ``held`` in the parts (combinations of ``part``) that ``new`` has."""
    return new if held is None else held.join(new.select(*part).distinct(), part, "left_anti").unionByName(new)


def ordered(edges: DataFrame) -> DataFrame:
    """Edges in the order they are read back: by every field that tells them apart."""
    return edges.orderBy("src_id", "dst_id", "kind", *[c for c in edges.columns if c not in ("src_id", "dst_id", "kind")])
