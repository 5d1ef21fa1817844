"""Tables kept up to date: a stream of changed files replaces their facts and derives anew what depends on them.

The store is a folder that driver and executors share. Each batch writes the facts of its files only (no other file is
parsed), the list of which batch has each file's facts, and the derived tables: rows of modules that the change can't reach
are taken over, the others derived. A batch that is delivered again writes the same places again, so it changes nothing.

What a change reaches are the modules that import what it names, directly or through others (names pass through imports,
and members through bases), found by the import statements as they are written, so that a module that appears or goes
reaches those that name it; and the packages above the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import prefixes
from ..operators.hierarchy import closure
from ..plans.checkpoints import cut
from ..sources.code import Tables, facts, of

EDGES = "owner string, src string, kind string, dst string, ord long"
NODES = "owner string, handle string, kind string, file string, line_start int, line_end int, signature string"
UNRESOLVED = "owner string, src string, edge string, target string"
FILES = "file string, module string, batch long"
#: Edges that a statement of the module at their end makes.
_REVERSE = ("subclasses", "imported_by")


class Store:
    """Derived tables of a folder at some batch: files, facts, nodes, edges, unresolved."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, batch: int | None, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema) if batch is None else self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/{batch}")

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/{batch}")

    def last(self, before: int | None = None) -> int | None:
        """The last finished batch (before another)."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/done")
        system = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = [int(f.getPath().getName()) for f in system.listStatus(at)] if system.exists(at) else []
        return max((n for n in done if before is None or n < before), default=None)

    def table(self, name: str, batch: int | None = None) -> DataFrame:
        """files, nodes, edges or unresolved as of a batch (the last unless given)."""
        schema = {"files": FILES, "nodes": NODES, "edges": EDGES, "unresolved": UNRESOLVED}[name]
        return self._read(name, self.last() if batch is None else batch, schema)

    def apply(self, changed: DataFrame, batch: int) -> None:
        """changed(module, file, content[, root_rank]): files as they are now, null content for those that are gone; of a
        file that comes twice, one row counts. Nothing is written for a batch that is done."""
        if self.last() is not None and self.last() >= batch:
            return
        before = self.last()
        rank = F.coalesce(F.col("root_rank"), F.lit(0)) if "root_rank" in changed.columns else F.lit(0)
        changed = changed.groupBy("file").agg(F.max(F.struct("module", "content", rank.alias("root_rank"))).alias("b")).select("file", "b.*")
        changed = cut(changed, "changed")
        self._write(facts(changed.where("content IS NOT NULL")), "facts", batch)
        old = self._read("files", before, FILES)
        kept = old.join(changed.select("file"), "file", "left_anti")
        self._write(kept.unionByName(changed.where("content IS NOT NULL").select("file", "module", F.lit(batch).cast("long").alias("batch"))), "files", batch)
        files = self._read("files", batch, FILES)
        batches = sorted(r[0] for r in files.select("batch").distinct().collect())  # one number a batch that still counts
        if not batches:
            for name, schema in (("nodes", NODES), ("edges", EDGES), ("unresolved", UNRESOLVED)):
                self._write(self.spark.createDataFrame([], schema), name, batch)
            return self._finish(batch)
        every = self.spark.read.parquet(*[f"{self.folder}/facts/{n}" for n in batches]).withColumn("_batch", F.regexp_extract("_metadata.file_path", r"/facts/(\d+)/", 1).cast("long"))
        every = every.join(files.select("file", F.col("batch").alias("_batch")), ["file", "_batch"], "left_semi").drop("_batch")
        tables = Tables(every)
        # facts of files that are gone still tell what they were imported for
        names = changed.select("module").unionByName(old.join(changed.select("file"), "file", "left_semi").select("module")).distinct()
        reached = cut(self._reached(tables, names), "reached")
        for name, schema, rows in (("nodes", NODES, _nodes(tables)), ("edges", EDGES, _edges(tables)), ("unresolved", UNRESOLVED, _unresolved(tables))):
            rest = self._read(name, before, schema).join(reached, "owner", "left_anti")
            self._write(rest.unionByName(rows.join(reached, "owner", "left_semi")), name, batch)
        self._finish(batch)

    def _reached(self, tables: Tables, names: DataFrame) -> DataFrame:
        """(owner): modules whose rows a change of the modules `names` (module) may change."""
        named = F.when(F.col("name").isNotNull() & (F.col("name") != "*"), F.array(F.concat_ws(".", "source", "name"))).otherwise(F.array().cast("array<string>"))
        imports = tables.imports.where("source IS NOT NULL").select(F.col("module").alias("child"), F.explode(F.concat(prefixes(F.col("source")), named)).alias("parent")).distinct()
        # a package offers what lies below it
        offered = names.select(F.explode(prefixes(F.col("module"))).alias("owner")).distinct()
        below = closure(imports, offered.select(F.col("owner").alias("root"))).select(F.col("handle").alias("owner"))
        return offered.unionByName(below).distinct()

    def _finish(self, batch: int) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/done/{batch}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True).close()

    def follow(self, stream: DataFrame, checkpoint: str, **trigger):
        """Apply a stream of changed files (a batch a micro-batch); the running query."""
        return stream.writeStream.foreachBatch(lambda df, n: self.apply(df, n)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _owners(tables: Tables) -> DataFrame:
    """(handle, owner): the module of every node."""
    nodes = tables.plain.select("handle", "kind", "file")
    inner = nodes.where("kind <> 'module'").join(of(tables.facts, "file").select("file", F.col("module").alias("owner")), "file").select("handle", "owner")
    return inner.unionByName(nodes.where("kind = 'module'").select("handle", F.col("handle").alias("owner"))).distinct()


def _nodes(tables: Tables) -> DataFrame:
    return tables.nodes.join(_owners(tables), "handle").select(*[c.split()[0] for c in NODES.split(", ")])


def _edges(tables: Tables) -> DataFrame:
    end = F.when(F.col("kind").isin(*_REVERSE), F.col("dst")).otherwise(F.col("src"))
    return tables.edges.withColumn("handle", end).join(_owners(tables), "handle").select(*[c.split()[0] for c in EDGES.split(", ")])


def _unresolved(tables: Tables) -> DataFrame:
    return tables.unresolved.withColumn("handle", F.col("src")).join(_owners(tables), "handle").select(*[c.split()[0] for c in UNRESOLVED.split(", ")])
