"""Directory trees linked by digest: expand, plan, verify, build."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.functions import exprs as X
from buildlens.session import checkpointed


#: Rounds after which a tree is held against its number of directories; links that one path may pass, as in POSIX systems.
LONG_CHAIN, LINK_HOPS = 64, 40


def _count(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def directories(nodes: DataFrame, roots: DataFrame) -> tuple[DataFrame, int]:
    """Every directory below each root with its path, level by level, and how many there are.

    Only directory entries take part in the loop; each level is checkpointed, so lineage does not grow. An entry that
    leads back to a directory above it, as only a damaged table has one, is not followed.
    """
    links = nodes.filter("is_dir").select("dir_hash", "name", "child_hash")
    frontier = checkpointed(
        roots.select(F.col("dir_hash").alias("root"), "dir_hash", F.lit("").alias("path"), F.array("dir_hash").alias("trail"))
    )
    found, total, rows = frontier.drop("trail"), 0, frontier.count()
    while rows:
        total += rows
        frontier = checkpointed(
            links.join(frontier, "dir_hash")
            .filter(~F.array_contains("trail", F.col("child_hash")))
            .select(
                "root",
                F.col("child_hash").alias("dir_hash"),
                _below("path", "name").alias("path"),
                F.array_append("trail", F.col("child_hash")).alias("trail"),
            )
        )
        rows = frontier.count()
        if rows:
            found = found.unionByName(frontier.drop("trail"))
    return found, total


def directory_uses(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, dir_hash, paths): on how many paths each directory lies below each root, the root itself on one.

    Rounds push counts along the links, so a round has one row per root and distinct directory, however many paths
    share it. Counts beyond 64 bits raise, and so does a table in which a directory lies below itself.
    """
    links = nodes.filter("is_dir").groupBy("dir_hash", "child_hash").agg(F.count(F.lit(1)).alias("times"))
    links = checkpointed(links)
    frontier = checkpointed(roots.select(F.col("dir_hash").alias("root"), "dir_hash", F.lit(1).cast("bigint").alias("paths")))
    found, rounds, most = frontier, 0, None
    while not frontier.isEmpty():
        rounds += 1
        if rounds >= LONG_CHAIN:  # a path without a loop is no longer than there are directories
            most = links.select("child_hash").distinct().count() if most is None else most
            if rounds > most + 1:
                raise ValueError("a directory lies below itself")
        frontier = checkpointed(
            links.join(frontier, "dir_hash")
            .groupBy("root", F.col("child_hash").alias("dir_hash"))
            .agg(F.sum(F.col("times") * F.col("paths")).alias("paths"))
        )
        found = found.unionByName(frontier)
    return found.groupBy("root", "dir_hash").agg(F.sum("paths").alias("paths"))


def _below(path: str, name: str) -> Column:
    return F.when(F.col(path) == "", F.col(name)).otherwise(F.concat_ws("/", path, name))


def _is_file(nodes: DataFrame) -> Column:
    """Neither a directory nor, in a table that has links, a link."""
    return ~F.col("is_dir") & (F.col("target").isNull() if "target" in nodes.columns else F.lit(True))


def flatten_tree(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Every file below each root with its full path. Files meet the directories once, after the loop; a directory
    that holds most files is one row on the directory side, and splits on the file side. Links are no files; see
    ``resolve_links``."""
    dirs, rows = directories(nodes, roots)
    files = nodes.filter(_is_file(nodes))
    return files.join(dirs, "dir_hash").select(
        "root",
        _below("path", "name").alias("path"),
        F.col("child_hash").alias("hash"),
        F.col("child_size").alias("size_bytes"),
        "is_executable",
    )


def get_tree(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Only the directories."""
    return directories(nodes, roots)[0].select("root", "path", "dir_hash")


def local_cache_split(files: DataFrame, local: DataFrame) -> DataFrame:
    """Each file with whether its content is already here."""
    have = local.select("hash").distinct().withColumn("_here", F.lit(True))
    return files.join(have, "hash", "left").withColumn("is_local", F.coalesce("_here", F.lit(False))).drop("_here")


def tree_plan(nodes: DataFrame, roots: DataFrame, local: DataFrame) -> DataFrame:
    """Files, downloads and bytes per root. A digest is fetched once, however many files share it."""
    return plan_of_uses(nodes, directory_uses(nodes, roots), local)


def plan_of_uses(nodes: DataFrame, uses: DataFrame, local: DataFrame) -> DataFrame:
    files = nodes.filter(_is_file(nodes)).select("dir_hash", F.col("child_hash").alias("hash"), "child_size")
    per_digest = files.join(uses, "dir_hash").groupBy("root", "hash").agg(F.sum("paths").alias("uses"), F.first("child_size").alias("size_bytes"))
    split = local_cache_split(per_digest, local)
    out = split.groupBy("root").agg(
        F.sum("uses").alias("files"),
        _count(~F.col("is_local")).alias("downloads"),
        F.coalesce(F.sum(F.when(~F.col("is_local"), F.col("size_bytes"))), F.lit(0)).alias("bytes_to_fetch"),
    )
    return out.withColumn("cached_files", F.col("files") - F.col("downloads"))


def tree_stats(nodes: DataFrame, roots: DataFrame, local: DataFrame) -> DataFrame:
    """The plan with the number of directories, the root included."""
    uses = checkpointed(directory_uses(nodes, roots))
    dirs = uses.groupBy("root").agg(F.sum("paths").alias("directories"))
    return dirs.join(plan_of_uses(nodes, uses, local), "root", "left").na.fill(0)


def _normal(path: Column) -> Column:
    """A path without ``.``, ``..`` and empty parts; null when it leaves the root."""
    start = F.array().cast("array<string>")

    def step(parts: Column, p: Column) -> Column:
        return (
            F.when(parts.isNull() | p.isin("", "."), parts)
            .when(p != "..", F.array_append(parts, p))
            .when(F.size(parts) > 0, F.slice(parts, F.lit(1), F.size(parts) - 1))
        )

    return F.array_join(F.aggregate(F.split(path, "/"), start, step), "/")


def _joined(above: Column, path: Column) -> Column:
    return F.when(above == "", path).otherwise(F.concat_ws("/", above, path))


def resolve_links(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Symbolic links below each root: (root, path, target, resolved, status).

    A node with a ``target`` is a link; its target is read from the directory that holds it, ``.`` and ``..`` by the
    path's own parts. Each round takes the first part of every open path that is a link and puts that link's target in
    its place; paths without one are settled as file, directory or ``dangling``. A path that comes back to where it was, or
    has passed ``LINK_HOPS`` links, is a ``loop``; an absolute target, or one above the root, is ``outside``. Only the
    first three have a resolved path. Work per round grows with the links, not with the files.
    """
    is_link = F.col("target").isNotNull()
    dirs = checkpointed(directories(nodes, roots)[0])
    links = checkpointed(
        nodes.filter(is_link).join(dirs, "dir_hash").select(
            "root", F.col("path").alias("above"), _below("path", "name").alias("path"), "target"
        )
    )

    def started(above: Column, target: Column) -> Column:
        return F.when(~target.startswith("/"), _normal(_joined(above, target)))

    at = links.select("root", "path", "target", started(F.col("above"), F.col("target")).alias("at"))
    open_ = checkpointed(at.withColumn("seen", F.array(F.col("at")).cast("array<string>")))
    steps = links.select("root", F.col("path").alias("prefix"), "above", F.col("target").alias("next"))
    done, hops = None, 0
    while not open_.isEmpty():
        hops += 1
        parts = F.split("at", "/")
        prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
        known = open_.filter(F.col("at").isNotNull())
        met = known.select("root", "path", F.explode(prefixes).alias("prefix")).join(steps, ["root", "prefix"])
        first = met.groupBy("root", "path").agg(F.min_by(F.struct("prefix", "above", "next"), F.length("prefix")).alias("via"))
        moved = checkpointed(open_.join(first, ["root", "path"], "left"))
        settled = moved.filter(F.col("via").isNull()).select("root", "path", "target", "at", F.when(F.col("at").isNull(), "outside").alias("status"))
        rest = F.substring(F.col("at"), F.length("via.prefix") + 1, F.length("at"))
        onward = moved.filter(F.col("via").isNotNull()).withColumn("at", started(F.col("via.above"), F.concat("via.next", rest)))
        loop = F.coalesce(F.array_contains("seen", F.col("at")), F.lit(False)) | F.lit(hops >= LINK_HOPS)
        loops = onward.filter(loop).select("root", "path", "target", F.lit(None).cast("string").alias("at"), F.lit("loop").alias("status"))
        settled = settled.unionByName(loops)
        done = settled if done is None else done.unionByName(settled)
        open_ = checkpointed(onward.filter(~loop).withColumn("seen", F.array_append("seen", F.col("at"))).drop("via"))
    if done is None:
        return links.select("root", "path", "target", F.col("target").alias("resolved"), F.col("target").alias("status"))
    done = checkpointed(done)
    files = nodes.filter(~F.col("is_dir") & ~is_link).join(dirs, "dir_hash").select("root", _below("path", "name").alias("at"), F.lit("file").alias("kind"))
    there = files.unionByName(dirs.select("root", F.col("path").alias("at"), F.lit("directory").alias("kind"))).distinct()
    out = done.join(there, ["root", "at"], "left")
    return out.select("root", "path", "target", F.col("at").alias("resolved"), F.coalesce("status", "kind", F.lit("dangling")).alias("status"))


def verify_tree(nodes: DataFrame, blobs: DataFrame) -> DataFrame:
    """Entries whose content is missing or does not have the digest that names it.

    Contents are hashed where they lie; only digests are shuffled. A directory is present when it has entries.
    """
    kept = blobs.groupBy("hash").agg(
        F.bool_or((X.digest_of(F.col("content")) == F.col("hash"))).alias("intact")
    )
    files = nodes.filter(_is_file(nodes)).join(kept, nodes["child_hash"] == kept["hash"], "left")
    dirs = nodes.filter("is_dir").join(
        nodes.select(F.col("dir_hash").alias("hash")).distinct().withColumn("intact", F.lit(True)),
        F.col("child_hash") == F.col("hash"),
        "left",
    )
    problem = F.when(F.col("intact").isNull(), "missing").when(~F.col("intact"), "corrupt")
    cols = ["dir_hash", "name", "child_hash", problem.alias("problem")]
    return files.select(*cols).unionByName(dirs.select(*cols)).filter(F.col("problem").isNotNull())


SPREAD_DIGITS = 4


def build_tree(files: DataFrame) -> DataFrame:
    """Directory digests bottom-up from files (root, path, hash, is_executable), and links if there is a ``target``.

    A directory's digest is taken over its entries in name order, in two steps: entries are first spread over
    16^4 groups by the digest of their name, then the group digests are digested. The result does not depend on
    listing order, and even a directory with most of all files is never gathered in one row.
    """
    parts = F.split("path", "/")
    target = F.col("target") if "target" in files.columns else F.lit(None).cast("string")
    files = files.withColumn("_kind", F.when(target.isNull(), "file").otherwise("link"))
    files = files.withColumn("hash", F.when(target.isNull(), F.col("hash")).otherwise(X.digest_of(target)))
    entries = checkpointed(
        files.select(
            "root",
            (F.size(parts) - 1).alias("depth"),
            F.when(F.size(parts) == 1, "").otherwise(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), "/")).alias(
                "parent"
            ),
            F.element_at(parts, -1).alias("name"),
            F.col("_kind").alias("kind"),
            F.coalesce(F.col("is_executable"), F.lit(False)).cast("int").cast("string").alias("flag"),
            "hash",
            F.lit(1).cast("bigint").alias("files"),
        )
    )
    depth = entries.agg(F.max("depth")).first()[0] or 0
    done, level_dirs = None, None
    for d in range(depth, -1, -1):
        level = entries.filter(F.col("depth") == d).drop("depth")
        if level_dirs is not None:
            level = level.unionByName(level_dirs)
        dirs = checkpointed(_digest_directories(level).withColumn("level", F.lit(d)))
        done = dirs if done is None else done.unionByName(dirs)
        p = F.split("path", "/")
        level_dirs = dirs.select(
            "root",
            F.when(F.size(p) == 1, "").otherwise(F.array_join(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(1))), "/")).alias("parent"),
            F.element_at(p, -1).alias("name"),
            F.lit("dir").alias("kind"),
            F.lit("0").alias("flag"),
            F.col("dir_hash").alias("hash"),
            "files",
        )
    return done


def _digest_directories(entries: DataFrame) -> DataFrame:
    line = F.concat_ws("|", "kind", "flag", "hash", "name")
    spread = F.substring(X.digest_of(F.col("name")), 1, SPREAD_DIGITS)
    groups = (
        entries.select("root", "parent", spread.alias("spread"), F.struct("name", line.alias("line")).alias("e"), "files")
        .groupBy("root", "parent", "spread")
        .agg(
            F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["line"]), "\n").cast("binary"), 256).alias("g"),
            F.sum("files").alias("files"),
            F.count(F.lit(1)).alias("children"),
        )
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct("spread", "g"))), lambda x: x["g"])
    return groups.groupBy("root", F.col("parent").alias("path")).agg(
        F.sha2(F.array_join(listed, "\n").cast("binary"), 256).alias("dir_hash"),
        F.sum("files").alias("files"),
        F.sum("children").alias("children"),
    )


def upload_stats(outputs: DataFrame, store: DataFrame, compat: bool = False) -> DataFrame:
    """Files, directories, bytes sent, files not sent and errors per action.

    A file is not sent when its digest is already stored; ``compat`` counts only empty files as such and adds the
    bytes of all others.
    """
    have = store.select("hash").distinct().withColumn("_stored", F.lit(True))
    ok = F.col("error").isNull()
    file = ok & ~F.col("is_directory")
    skipped = F.col("size_bytes") == 0 if compat else F.coalesce("_stored", F.lit(False))
    return outputs.join(have, "hash", "left").groupBy("action_id").agg(
        _count(file).alias("files"),
        _count(ok & F.col("is_directory")).alias("directories"),
        _count(file & skipped).alias("cached_files"),
        F.coalesce(F.sum(F.when(file & ~skipped, F.col("size_bytes"))), F.lit(0)).alias("bytes_uploaded"),
        _count(~ok).alias("errors"),
    )
