"""Halo assignments from external catalogues: (ptype, pidx) to field halo and subhalo."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from astroloom.operators.hierarchy import resolve_forest
from astroloom.operators.membership import deepest, expand_runs, interval_lookup, number_rows, rekey
from astroloom.tables import cut

SOURCES = ("SNAPSHOT", "FOF", "SNAP_OR_FOF", "AHF", "HBT-HERONS", "SUBFIND")


def choose_source(name: str, types_with_ids: dict[str, bool]) -> str:
    """The source that is used: SNAP_OR_FOF takes stored ids only if every particle type has them."""
    if name not in SOURCES:
        raise ValueError(f"halo source {name!r} is none of {SOURCES}")
    if name == "SNAP_OR_FOF":
        return "SNAPSHOT" if types_with_ids and all(types_with_ids.values()) else "FOF"
    if name == "SNAPSHOT" and not any(types_with_ids.values()):
        raise ValueError("the snapshot stores no halo ids")
    return name


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, parts): the lines of a text that are no comments, with a key that orders them as the file does."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    lines = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    # rows of a block come in order within their task, whatever order tasks take blocks in
    return lines.select(F.struct("f", "b", "i").alias("line"), F.split(F.trim("value"), r"\s+").alias("parts"))


def _number(place: int) -> F.Column:
    return F.get("parts", F.lit(place)).try_cast("long")


def ahf_halos(spark: SparkSession, path: str) -> DataFrame:
    """(id, host, n) from the halo text: tab-separated, one header line, columns 0, 1 and 4; host 0 is a field halo."""
    return _lines(spark, path).select(_number(0).alias("id"), _number(1).alias("host"), _number(4).alias("n")).where("id is not null")


def ahf_source(spark: SparkSession, halos_path: str, particles_path: str) -> tuple[DataFrame, DataFrame]:
    """(memberships (pid, halo), halos (id, host)) from both texts. Halos are numbered from 1 in the order of the file, since their own ids
    are too large to be used as numbers; host 0 is a field halo, and so is one whose host the file does not have."""
    rows = _lines(spark, halos_path).select("line", _number(0).alias("id"), _number(1).alias("host")).where("id is not null")
    rows = cut(number_rows(rows, [F.asc("line")], "row").select((F.col("row") + 1).alias("number"), "id", "host"), "halos")
    hosts = rows.select(F.col("id").alias("host"), F.col("number").alias("host_number"))
    halos = rows.join(hosts, "host", "left").select(F.col("number").alias("id"), F.coalesce("host_number", F.lit(0)).alias("host"))
    pairs = _lines(spark, particles_path).select("line", _number(0).alias("c0"), _number(1).alias("c1")).where("c0 is not null and c1 is not null")
    return ahf_runs(pairs).select("pid", (F.col("halo_row") + 1).alias("halo")), halos


def ahf_runs(pairs: DataFrame, order: str = "line") -> DataFrame:
    """(pid, halo row) from numbered lines (line, c0, c1): a line whose second number exceeds 5 opens the next halo.

    Particle types are at most 5, so only openings exceed it. The running number of openings is taken over ranges
    of lines: counts of the ranges before are added to the count inside, so the file is never sorted in one task.
    """
    numbered = number_rows(pairs, [F.asc(order)], "__row")
    block = F.floor(F.col("__row") / 65536)
    opens = F.when(F.col("c1") > 5, 1).otherwise(0)
    rows = numbered.withColumns({"__block": block, "__open": opens})
    inside = Window.partitionBy("__block").orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("__block").agg(F.sum("__open").alias("__n"))
    sums = sums.withColumn("__ahead", F.coalesce(F.sum("__n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per 65536 lines
    rows = rows.withColumn("__seen", F.sum("__open").over(inside)).join(sums.select("__block", "__ahead"), "__block")
    return rows.where("__open = 0").select(F.col("c0").alias("pid"), (F.col("__ahead") + F.col("__seen") - 1).alias("halo_row"))


def match_nested(particles: DataFrame, memberships: DataFrame, halos: DataFrame) -> DataFrame:
    """Field and subhalo of every particle from memberships (pid, halo) and halos (id, host).

    A particle belongs to its deepest halo; its field halo is the top of that one's chain, its subhalo the deepest
    itself where it is below the top. Particles that no halo names get -1.
    """
    forest = resolve_forest(halos, "id", "host", 0).nodes.select(F.col("id").alias("halo"), "root", (F.col("depth") - 1).alias("level"))
    known = memberships.join(forest, "halo")
    best = deepest(known, "pid", "level", "halo").select("pid", F.col("root").alias("field_halo"), F.when(F.col("level") > 0, F.col("halo")).otherwise(F.lit(-1)).alias("sub_halo"))
    out = particles.join(best, "pid", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("field_halo", "sub_halo")})


def match_offsets(particles: DataFrame, listed: DataFrame, subhalos: DataFrame) -> DataFrame:
    """Field and subhalo from a particle list (place, pid) and subhalos (track_id, host_halo, parent_track, depth, n_bound, offset).

    A place belongs to the subhalo with the last offset at or before it. Where a host is given the field halo is that
    host, else the subhalo's own track stands for a field halo of its own; a subhalo counts as such only with a depth above 0
    and a host. Field halos are numbered as rows: hosts and promoted tracks in one numbering.
    """
    bound = subhalos.where(F.col("n_bound") > 0) if "n_bound" in subhalos.columns else subhalos
    tagged = interval_lookup(listed.withColumn("__k", F.lit(0)), ["__k"], "place", bound.withColumn("__k", F.lit(0)), "offset", "track_id", "host_halo", "depth").drop("__k")
    field = F.when(F.col("host_halo") >= 0, F.concat(F.lit("h"), F.col("host_halo"))).when(F.col("track_id").isNotNull(), F.concat(F.lit("t"), F.col("track_id")))
    tagged = tagged.select("pid", field.alias("field_key"), F.when((F.col("depth") > 0) & (F.col("host_halo") >= 0), F.col("track_id")).otherwise(F.lit(-1)).alias("sub_halo"))
    keys = number_rows(tagged.where("field_key is not null").select("field_key").distinct(), [F.asc("field_key")], "field_halo")
    best = deepest(tagged.join(keys, "field_key"), "pid", "sub_halo").drop("field_key")
    out = particles.join(best, "pid", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("field_halo", "sub_halo")})


def herons_source(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(listed (place, pid), subhalos) of a catalogue folder with the tables ``Subhalos`` and ``Particles`` under their own column names.

    Particles come in the order of the rows of their table. A catalogue without particles is a FileNotFoundError.
    """
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/Particles.parquet")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        raise FileNotFoundError(f"{path} has no particles")
    subs = spark.read.parquet(f"{path}/Subhalos.parquet").select(
        F.col("TrackId").cast("long").alias("track_id"), F.col("HostHaloId").cast("long").alias("host_halo"), F.col("NestedParentTrackId").cast("long").alias("parent_track"),
        F.col("Depth").cast("int").alias("depth"), F.col("Nbound").cast("long").alias("n_bound"), F.col("ParticleOffset").cast("long").alias("offset"),
    )
    return file_places(spark.read.parquet(f"{path}/Particles.parquet"), "ParticleIDs", "place").select("place", F.col("ParticleIDs").cast("long").alias("pid")), subs


def file_places(df: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): a Parquet table's column with the place of its row in the files, taken in order of their names."""
    rows = df.select(column, F.struct(F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i")).alias("__at"))
    return number_rows(rows, [F.asc("__at")], name).select(column, name)


def subfind_source(spark: SparkSession, path: str, codes: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """(placed (ptype, position, group, sub), parents (sub, parent, group)) of a catalogue folder with the tables ``Group`` and ``Subhalo``.

    Rows of both tables are numbered as they lie in the files. ``codes`` are the places of the particle types in the length arrays.
    """
    groups = number_rows(spark.read.parquet(f"{path}/Group.parquet").select("*", F.struct("_metadata.file_name", "_metadata.row_index").alias("__at")), [F.asc("__at")], "group")
    groups = cut(groups.select("group", F.col("GroupFirstSub").cast("long").alias("first_sub"), F.col("GroupLenType").alias("lengths")), "groups")
    subs = number_rows(spark.read.parquet(f"{path}/Subhalo.parquet").select("*", F.struct("_metadata.file_name", "_metadata.row_index").alias("__at")), [F.asc("__at")], "sub")
    subs = cut(subs.select("sub", F.col("SubhaloGrNr").cast("long").alias("group"), F.col("SubhaloParent").cast("long").alias("local_parent"), F.col("SubhaloLenType").alias("lengths")), "subs")
    kinds = F.explode(F.array(*[F.struct(F.lit(p).alias("ptype"), F.get("lengths", F.lit(c)).cast("long").alias("length")) for p, c in codes.items()]))
    long = lambda df, *keys: df.select(*keys, kinds.alias("k")).select(*keys, "k.ptype", "k.length")
    placed = subfind_membership(long(groups, "group"), long(subs, "group", "sub"))
    return placed, subfind_parents(subs, groups).join(subs.select("sub", "group"), "sub")


def nested_subhaloes(halos: DataFrame) -> DataFrame:
    """(id, parent, host) of the halos (id, host) that lie in another: parent -1 directly below the field halo, host the field halo."""
    nodes = resolve_forest(halos, "id", "host", 0, tour=False).nodes.where("depth > 1")
    return nodes.select("id", F.when(F.col("parent") == F.col("root"), F.lit(-1)).otherwise(F.col("parent")).alias("parent"), F.col("root").alias("host"))


def track_subhaloes(subhalos: DataFrame, matched: DataFrame) -> DataFrame:
    """(id, parent, host) of tracks below a field halo, hosts numbered as in ``matched`` (field_halo, sub_halo)."""
    subs = subhalos.where("depth > 0 and host_halo >= 0")
    fields = matched.where("sub_halo >= 0").groupBy(F.col("sub_halo").alias("track_id")).agg(F.min("field_halo").alias("host"))
    hosts = subs.join(fields, "track_id").groupBy("host_halo").agg(F.min("host").alias("host"))
    known = subs.select(F.col("track_id").alias("parent_track"), F.lit(True).alias("below"))
    out = subs.join(hosts, "host_halo").join(known, "parent_track", "left")
    return out.select(F.col("track_id").alias("id"), F.when(F.col("below"), F.col("parent_track")).otherwise(F.lit(-1)).alias("parent"), "host")


def subfind_parents(subhalos: DataFrame, groups: DataFrame) -> DataFrame:
    """(sub, parent): parents as global subhalo numbers from places within a group.

    ``subhalos`` (sub, group, local_parent), ``groups`` (group, first_sub). The central and direct children of
    place 0 have no parent (-1); so have subhalos of groups without a first subhalo.
    """
    rows = subhalos.join(groups.select("group", "first_sub"), "group", "left")
    place = F.col("sub") - F.col("first_sub")
    top = (F.coalesce("first_sub", F.lit(-1)) < 0) | (F.col("local_parent") == place) | (F.col("local_parent") == 0)
    return rows.select("sub", F.when(top, F.lit(-1)).otherwise(F.col("first_sub") + F.col("local_parent")).alias("parent"))


def subfind_membership(group_lengths: DataFrame, subhalo_lengths: DataFrame, ptype: str = "ptype") -> DataFrame:
    """(ptype, position, group, sub): file positions from run lengths per group and per subhalo.

    ``group_lengths`` (ptype, group, length), ``subhalo_lengths`` (ptype, group, sub, length). Subhalos lie at the start of
    their group in order; the rest of a group belongs to no subhalo (-1); positions behind all groups have no row.
    """
    placed = expand_runs(group_lengths, [ptype], "group", "length").select(ptype, "group", "position")
    starts = placed.groupBy(ptype, "group").agg(F.min("position").alias("start"))
    inner = expand_runs(subhalo_lengths, [ptype, "group"], "sub", "length", "inside").select(ptype, "group", "sub", "inside")
    inner = inner.join(starts, [ptype, "group"]).select(ptype, (F.col("start") + F.col("inside")).alias("position"), "sub")
    return placed.join(inner, [ptype, "position"], "left").withColumn("sub", F.coalesce("sub", F.lit(-1)))


def snapshot_halos(particles: DataFrame, column: str = "halo_id") -> DataFrame:
    """Stored halo numbers made contiguous: ``field_halo`` from 0, -1 for none."""
    return rekey(particles, column, "field_halo")


def write_halo_ids(ids: DataFrame, path: str, provenance: dict[str, str], encode=None, overwrite_own: bool = True) -> bool:
    """Writes (ptype, pidx, halo_id) with its provenance beside a snapshot; ids of another origin are never replaced.

    Returns whether they were written. A folder that cannot be written gives False.
    """
    spark = ids.sparkSession
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        if not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/provenance.parquet")):
            raise FileExistsError(f"{path} holds halo ids of another origin")
        if not overwrite_own:
            raise FileExistsError(path)
    out = ids.withColumn("halo_id", encode(F.col("halo_id"))) if encode else ids
    try:
        out.write.mode("overwrite").parquet(f"{path}/ids.parquet")
        spark.createDataFrame([(k, str(v)) for k, v in provenance.items()], "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/provenance.parquet")
    except Exception as failed:  # a read-only folder
        if "Permission" in str(failed) or "Read-only" in str(failed) or "mkdir" in str(failed).lower():
            return False
        raise
    return True
