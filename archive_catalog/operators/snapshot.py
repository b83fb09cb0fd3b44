"""Ingest of a snapshot: deltas, upserts, directory trees, counters, volumes and integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as tx

KEY = ["volume_id", "rel_path"]
RANKS = {"DISCOVERED": 0, "HASHED": 1, "METADATA_READ": 2, "FINGERPRINTED": 3}


def file_record(files: DataFrame, path: str = "rel_path") -> DataFrame:
    """Keys and classification of every path in one projection."""
    name = tx.base_name(F.col(path))
    return files.select(
        path, name.alias("filename"), tx.extension(name).alias("extension"), F.lower(name).alias("filename_lower"), tx.normalise(name).alias("filename_norm"),
        tx.normalise_ascii(name).alias("filename_norm_ascii"), tx.file_type(name).alias("file_type"), tx.is_hidden(name).alias("is_hidden"), tx.is_system(name).alias("is_system"), tx.cover_role(name).alias("cover_role"),
    )


def sanitize(df: DataFrame) -> DataFrame:
    """Every string column without NUL and with valid UTF-8."""
    return df.select(*[tx.sanitised(F.col(c)).alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes])


def status_rank(status: Column) -> Column:
    out = F.lit(0)
    for name, rank in RANKS.items():
        out = F.when(status == name, rank).otherwise(out)
    return out


def scan_delta(incoming: DataFrame, existing: DataFrame, with_hash: bool = True, with_tags: bool = True) -> DataFrame:
    """Incoming entries with what is known of them: is_new, changed, need_hash, need_meta and the next status.

    ``existing``: key, size_bytes, mtime, content_hash, status. A status never falls unless the file changed; a hash that is there stays valid
    until then.
    """
    old = existing.select(*KEY, *[F.col(c).alias(f"old_{c}") for c in ("size_bytes", "mtime", "content_hash", "status")], F.lit(True).alias("known"))
    both = incoming.join(old, KEY, "left")
    new = F.col("known").isNull()
    changed = ~new & ((F.col("size_bytes") != F.col("old_size_bytes")) | ~F.col("mtime").eqNullSafe(F.col("old_mtime")))
    redo = new | changed
    need_hash = F.lit(with_hash) & (redo | F.col("old_content_hash").isNull())
    need_meta = F.lit(with_tags) & (tx.file_type(F.col("rel_path")) == "AUDIO") & (redo | (status_rank(F.coalesce(F.col("old_status"), F.lit(""))) < RANKS["METADATA_READ"]))
    reached = F.when(need_meta, RANKS["METADATA_READ"]).when(need_hash, RANKS["HASHED"]).otherwise(RANKS["DISCOVERED"])
    rank = F.when(redo, reached).otherwise(F.greatest(reached, status_rank(F.coalesce(F.col("old_status"), F.lit("")))))
    status = F.get(F.array(*[F.lit(s) for s in RANKS]), rank)
    return both.select(*incoming.columns, new.alias("is_new"), changed.alias("changed"), need_hash.alias("need_hash"), need_meta.alias("need_meta"), status.alias("status"))


def snapshot_upsert(existing: DataFrame, incoming: DataFrame, seen_at: Column, key: list[str] | None = None) -> DataFrame:
    """The table after the snapshot: incoming values win, first_seen stays, last_seen moves; rows not in the snapshot stay as they are.

    ``existing`` has all columns of ``incoming`` plus first_seen and last_seen. Incoming rows of one key must be one.
    """
    key = key or KEY
    values = [c for c in incoming.columns if c not in key]
    new = incoming.select(*key, *[F.col(c).alias(f"new_{c}") for c in values], F.lit(True).alias("arrived"))
    both = existing.join(new, key, "full_outer")
    came = F.col("arrived").isNotNull()
    return both.select(
        *key, *[F.when(came, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in values],
        F.coalesce("first_seen", seen_at).alias("first_seen"), F.when(came, seen_at).otherwise(F.col("last_seen")).alias("last_seen"),
    )


def insert_ignore(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Existing rows and those incoming whose key is new; of equal keys the least row."""
    rest = [c for c in existing.columns if c not in key]
    one = incoming.groupBy(*key).agg(F.min(F.struct(*rest)).alias("r")).select(*key, "r.*") if rest else incoming.select(*key).distinct()
    return existing.unionByName(one.join(existing.select(*key), key, "left_anti").select(*existing.columns))


def replace_children(existing: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """Children of parents that arrive are replaced as a whole; others stay."""
    return existing.join(incoming.select(parent).distinct(), parent, "left_anti").unionByName(incoming.select(*existing.columns))


def directory_tree(paths: DataFrame) -> DataFrame:
    """Every directory above the given file paths: volume_id, rel_path ("" is the root), depth, parent_path."""
    parts = F.split("rel_path", "/")
    # prefixes are made per distinct directory, not per file
    direct = paths.select("volume_id", F.slice(parts, 1, F.size(parts) - 1).alias("dirs")).distinct()
    each = direct.select("volume_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("dirs")), lambda n: F.slice(F.col("dirs"), 1, n))).alias("d")).distinct()
    up = F.slice("d", 1, F.greatest(F.size("d") - 1, F.lit(0)))
    return each.select("volume_id", F.array_join("d", "/").alias("rel_path"), F.size("d").alias("depth"), F.when(F.size("d") > 0, F.array_join(up, "/")).alias("parent_path"))


def with_parent(tree: DataFrame) -> DataFrame:
    """Adds the directory's and its parent's ids."""
    own = tree.withColumn("directory_id", schemas.surrogate_key(F.col("volume_id"), F.col("rel_path")))
    parent = own.select("volume_id", F.col("rel_path").alias("parent_path"), F.col("directory_id").alias("parent_id"))
    return own.join(parent, ["volume_id", "parent_path"], "left")


def file_directory(files: DataFrame, directories: DataFrame) -> DataFrame:
    """Files with the directory that holds them; the volume's root where none is known."""
    parts = F.split("rel_path", "/")
    parent = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    named = directories.select("volume_id", F.col("rel_path").alias("dir_path"), "directory_id")
    roots = directories.where("rel_path = ''").select("volume_id", F.col("directory_id").alias("root_id"))
    return (
        files.withColumn("dir_path", parent).join(named, ["volume_id", "dir_path"], "left").join(roots, "volume_id", "left")
        .withColumn("directory_id", F.coalesce("directory_id", "root_id")).drop("root_id")
    )


def directory_counts(directories: DataFrame, files: DataFrame) -> DataFrame:
    """Direct files, audio files and whether a cue sheet is there, for every directory; 0 for emptied ones."""
    n = files.groupBy("directory_id").agg(F.count("*").alias("file_count"), F.count_if(F.col("file_type") == "AUDIO").alias("audio_count"), F.bool_or(F.col("file_type") == "CUE").alias("has_cue"))
    return directories.join(n, "directory_id", "left").fillna({"file_count": 0, "audio_count": 0, "has_cue": False})


def subtree_totals(directories: DataFrame, files: DataFrame) -> DataFrame:
    """Files, audio files, bytes and directories of each directory's whole subtree, itself included; ``height`` is the depth of the deepest directory below it.

    Counts per directory are made first and then given to every ancestor, which its path names: one row a directory and level instead of one a file,
    summed by tasks before they meet, so a root is no hot key. A chain of any depth takes the same two aggregations, not one a level.
    """
    own = directory_counts(directories.select("volume_id", "rel_path", "directory_id", "depth"), files).join(
        files.groupBy("directory_id").agg(F.sum("size_bytes").alias("bytes")), "directory_id", "left"
    )
    parts = F.filter(F.split("rel_path", "/"), lambda p: p != "")
    upto = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    each = own.select("volume_id", F.explode(upto).alias("rel_path"), "file_count", "audio_count", F.coalesce("bytes", F.lit(0)).alias("bytes"), "depth")
    sums = each.groupBy("volume_id", "rel_path").agg(
        F.sum("file_count").alias("tree_files"), F.sum("audio_count").alias("tree_audio"), F.sum("bytes").alias("tree_bytes"), F.count("*").alias("tree_directories"), F.max("depth").alias("deepest")
    )
    found = directories.select("volume_id", "rel_path", "directory_id", "depth").join(sums, ["volume_id", "rel_path"])
    return found.select("directory_id", "tree_files", "tree_audio", "tree_bytes", "tree_directories", (F.col("deepest") - F.col("depth")).alias("height"))


def run_counters(files: DataFrame, directory: str = "directory_id") -> DataFrame:
    """Totals of one scan."""
    return files.agg(
        F.countDistinct(directory).alias("dirs_seen"), F.count("*").alias("files_seen"), F.count_if(F.col("file_type") == "AUDIO").alias("audio_seen"),
        F.count_if(F.col("status") == "ERROR").alias("errors"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes_seen"),
    )


def volume_match(probes: DataFrame, volumes: DataFrame) -> DataFrame:
    """Probes with the id of the known volume: by serial; without a serial by detected label, size and file system among volumes without one."""
    by_serial = volumes.where("serial IS NOT NULL").groupBy("serial").agg(F.min("volume_id").alias("serial_match"))
    soft = volumes.where("serial IS NULL").groupBy("label", "total_bytes", "fs_type").agg(F.min("volume_id").alias("soft_match"))
    p, s = probes.alias("p"), soft.alias("s")
    near = F.col("p.serial").isNull() & (F.col("p.label") == F.col("s.label")) & (F.col("p.total_bytes") == F.col("s.total_bytes")) & F.col("p.fs_type").eqNullSafe(F.col("s.fs_type"))
    return (
        p.join(s, near, "left").select("p.*", "soft_match").join(by_serial, "serial", "left")
        .withColumn("matched_id", F.when(F.col("serial").isNotNull(), F.col("serial_match")).otherwise(F.col("soft_match"))).drop("serial_match", "soft_match")
    )


def register_volumes(probes: DataFrame, volumes: DataFrame) -> DataFrame:
    """The volumes after registration of all probes (probe_id, serial, label, given_label, fs_type, total_bytes), in the order of probe_id.

    A matched volume takes the given or else the detected label (UNNAMED if neither) of its last probe and the last file system and size that were detected. Probes
    that match none are one new volume for each serial, without a serial for each (label, size, file system); one without these too is a volume of its own.
    A new volume has the id of its first probe.
    """
    hit = volume_match(probes, volumes)
    named = F.coalesce("given_label", "label", F.lit("UNNAMED"))
    soft = F.col("label").isNotNull() & F.col("total_bytes").isNotNull()
    key = (
        F.when(F.col("matched_id").isNotNull(), F.concat(F.lit("id "), "matched_id")).when(F.col("serial").isNotNull(), F.concat(F.lit("serial "), "serial"))
        .when(soft, F.concat(F.lit("soft "), F.to_json(F.struct("label", "total_bytes", "fs_type")))).otherwise(F.concat(F.lit("probe "), "probe_id"))
    )
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("probe_id"))).alias(c)
    one = hit.withColumns({"_key": key, "named": named}).groupBy("_key").agg(
        F.min("matched_id").alias("matched_id"), F.min("probe_id").alias("first"), F.min("serial").alias("serial"), last("named"), last("fs_type"), last("total_bytes")
    )
    known = one.where("matched_id IS NOT NULL").select(F.col("matched_id").alias("volume_id"), "named", F.col("fs_type").alias("fs"), F.col("total_bytes").alias("size"))
    kept = volumes.join(known, "volume_id", "left").select(
        "volume_id", F.coalesce("named", "label").alias("label"), "serial", F.coalesce("fs", "fs_type").alias("fs_type"), F.coalesce("size", "total_bytes").alias("total_bytes")
    )
    new = one.where("matched_id IS NULL").select(F.col("first").alias("volume_id"), F.col("named").alias("label"), "serial", "fs_type", "total_bytes")
    return kept.unionByName(new)


def integrity_report(tables: dict[str, DataFrame], unique: dict[str, list[str]], foreign: list[tuple[str, str, str, str]], enums: list[tuple[str, str, tuple[str, ...]]], not_negative: list[tuple[str, str]]) -> DataFrame:
    """(rule, subject, violations): counts of rows that break a rule, of rules that are broken.

    All rules of single rows are counted in one pass over their table. A key rule takes one aggregate by the key; a reference is looked up
    by its distinct values, counted first, so neither a hot key nor a long child table travels.
    """
    rules: dict[str, list[tuple[str, str, Column]]] = {}
    for name, column, allowed in enums:
        rules.setdefault(name, []).append(("enum", f"{name}.{column}", ~F.col(column).isin(*allowed)))
    for name, column in not_negative:
        rules.setdefault(name, []).append(("range", f"{name}.{column}", F.col(column) < 0))
    parts = []
    for name, own in rules.items():
        counted = tables[name].agg(*[F.count_if(broken).alias(f"_{i}") for i, (_, _, broken) in enumerate(own)])
        listed = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(subject).alias("subject"), F.col(f"_{i}").alias("violations")) for i, (rule, subject, _) in enumerate(own)])
        parts.append(counted.select(F.explode(listed).alias("r")).select("r.*"))
    one = lambda rule, subject, rows: rows.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("violations")).select(F.lit(rule).alias("rule"), F.lit(subject).alias("subject"), "violations")
    for name, key in unique.items():
        parts.append(one("unique", f"{name}({','.join(key)})", tables[name].groupBy(*key).agg((F.count("*") - 1).alias("n"))))
    for child, column, parent, pk in foreign:
        values = tables[child].where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
        parts.append(one("foreign", f"{child}.{column}", values.join(tables[parent].select(F.col(pk).alias(column)), column, "left_anti")))
    return reduce(lambda x, y: x.unionByName(y), parts).where("violations > 0")


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
