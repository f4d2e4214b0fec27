"""Pieces that several operators share: the word rule, the learning fold, batch sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.session import ship_package

#: ASCII characters that separate words: all but digits and letters. They are listed one by one because
#: Java's regex tests such a class by one table look-up, a class of ranges by a chain of predicates.
_GAPS = "".join(f"\\x{i:02X}" for i in range(128) if not chr(i).isalnum())
#: What separates words, and the words themselves, in a text that is not lower-cased yet: the same runs
#: as ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` finds once A-Z are lower-cased.
GAP, WORD_ANY_CASE = f"[{_GAPS}]+", f"[^{_GAPS}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. A text of single bytes takes the fast built-in, others go letter by letter."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words_of(c: Column) -> Column:
    """Array of the words of a text; null and wordless texts have none."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(c), GAP), ""), F.array().cast("array<string>"))


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD_ANY_CASE)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text mod 5 is 0. A null id is not held out, and is not learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learnable(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 != 0, F.lit(False))


def order_key(*cols: Column) -> Column:
    """A fixed pseudo-random order for bounded samples."""
    return F.xxhash64(*cols)


def text_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of whole texts stay small however long the texts are; the executors get this package."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, *stem: str) -> list[str]:
    """Column names that the table does not have yet, whatever its own are called."""
    have, out = {c.lower() for c in df.columns}, []
    for s in stem:
        name = f"__{s}"
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


_LOCAL: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. Where the session names none: the context's own checkpoint folder, or, on a
    test machine only, one temporary folder for the whole session."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named and sc.master.startswith("local["):
        import tempfile

        named = _LOCAL.setdefault(sc.applicationId, "")
        if not named:
            named = _LOCAL[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="gridlake-checkpoint-")
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named


def near(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A table of ids, marked for broadcast if it has at most ``most`` rows (some 16 MB); a larger one is shuffled."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def give_back(spark: SparkSession | None = None) -> None:
    """Return freed memory to the system: after a fit, and, if a session is named, after a step of many joins. The driver
    shares its memory with a JVM, whose hundreds of short-lived threads leave freed memory in their allocator's arenas.
    Its collection also lets go of broadcasts and shuffle files that nothing refers to any more."""
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
    if spark is not None:
        spark._jvm.System.gc()
        trim_native(spark)


def trim_native(spark: SparkSession) -> bool:
    """Let the driver's JVM return what its native allocator holds but does not use; False if that JVM cannot (before
    Java 17.0.9, or not on Linux with glibc)."""
    from py4j.protocol import Py4JError

    jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        # the server's own class is closed to reflection, its interface is open
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        given = new_array(jvm.java.lang.Object, 4)
        given[0], given[1] = name, "systemTrimNativeHeap"
        return "rim native heap" in str(invoke.invoke(server, given))
    except Py4JError:
        return False


def cut(df: DataFrame, codec: str | None = None) -> DataFrame:
    """The table, written once to the shared checkpoint folder and read from there: lineage ends, lost executors cost
    nothing before it, and the optimizer sees the files' sizes. (``checkpoint()`` runs its last stage twice and keeps the
    size estimates of the whole past, which grow with every join of a loop.) All tables of an application lie in one
    folder named after it; ``discard`` removes those that no result reads any more. ``codec`` compresses it otherwise than
    the session does, for tables of whole texts."""
    import uuid

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/gridlake-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``cut`` wrote and that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_written_at", None)
        if path:
            jvm, sc = t.sparkSession._jvm, t.sparkSession.sparkContext
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of one key from which its rows are dealt over several tasks.
HOT = 10_000


def heavy_keys(many: DataFrame, key: str, hot: int = HOT) -> DataFrame | None:
    """key, __parts: the keys of more than ``hot`` rows, and over how many tasks each is dealt; None if there is none. The
    list has at most rows / ``hot`` entries. ``many`` is read twice: it should be a written table."""
    if many.count() <= hot:
        return None
    heavy = cut(many.groupBy(key).agg(F.count("*").alias("__parts")).where(F.col("__parts") > hot).select(key, F.ceil(F.col("__parts") / hot).cast("int").alias("__parts")))
    if heavy.isEmpty():
        discard(heavy)
        return None
    return heavy


def look_up_dealt(many: DataFrame, one: DataFrame, key: str, heavy: DataFrame | None) -> DataFrame:
    """Inner join of many rows a key with the one row that ``one`` has for it. ``heavy`` (see ``heavy_keys``) is broadcast:
    its keys are dealt over as many tasks as they need, and the one row is repeated for each."""
    if heavy is None:
        return many.join(one, key)
    heavy = F.broadcast(heavy)
    dealt_by = [f.name for f in many.schema if f.dataType.typeName() != "array"]
    left = many.join(heavy, key, "left").withColumn("__part", F.pmod(F.xxhash64(*dealt_by), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    right = one.join(heavy, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return left.join(right, [key, "__part"]).drop("__part")


def look_up(many: DataFrame, one: DataFrame, key: str, hot: int = HOT) -> DataFrame:
    """Inner join of many rows a key, a written table, with the one row that ``one`` has for it; keys of more than ``hot``
    rows are dealt over several tasks."""
    return look_up_dealt(many, one, key, heavy_keys(many, key, hot))
