"""Source files as rows, and which of them a scan looks at."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions.text import extension

# Extensions to languages, for scans and for the editor.
EXTENSIONS = {
    ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript",
    ".jsx": "javascript", ".go": "go", ".rs": "rust", ".java": "java", ".rb": "ruby",
    ".php": "php", ".cs": "csharp", ".swift": "swift", ".kt": "kotlin",
}
EDITOR_EXTENSIONS = {
    ".py": "python", ".pyw": "python", ".pyi": "python", ".ts": "typescript",
    ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript",
    ".go": "go",
}
# What each checker reads.
CHECKER_EXTENSIONS = {
    "python": (".py",),
    "typescript": (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"),
    "go": (".go",),
}
# Languages that have a pack.
PACK_LANGUAGES = ("python", "typescript", "javascript", "go")
# Directories nobody scans, by who walks the tree.
SKIP_DIRS = {
    "detector": (
        "node_modules", ".git", ".venv", "venv", "env", "__pycache__", "dist", "build",
        ".tox", ".mypy_cache", ".next", "coverage", "vendor", ".cache", ".terraform",
    ),
    "python": (
        "node_modules", ".git", ".venv", "venv", "env", "__pycache__", "dist", "build",
        ".tox", ".mypy_cache",
    ),
    "typescript": (
        "node_modules", ".git", "dist", "build", "coverage", ".next", ".cache",
        "__pycache__", ".venv", "vendor",
    ),
    "go": ("vendor", ".git", "node_modules", "dist", "build", "testdata", ".cache"),
    "editor": (
        "node_modules", "__pycache__", ".git", "venv", ".venv", "dist", "build", ".tox",
        ".mypy_cache",
    ),
}
# Walkers that enter hidden directories not on their list.
ENTERS_HIDDEN = ("python",)


#: Small files go to Spark together, up to so many characters.
_READ_CHARS = 1_000_000


def _folder(root: str):
    """File system and path of ``root`` for the tasks that walk and read it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root else f"file://{root.removeprefix('file:')}")


def list_source_files(spark: SparkSession, root: str, extensions=None) -> DataFrame:
    """``(repo, path, ext, size)`` of every file below ``root``; its first folders are the repos.

    The driver lists the repositories, tasks walk them; no text is read. Empty files, and names
    that begin with a dot or an underscore, are there too, unlike with Spark's readers.
    """
    wanted = sorted(extensions or {*EXTENSIONS, *EDITOR_EXTENSIONS, ".cjs"})
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    listing = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(top)
    repos = sorted(s.getPath().getName() for s in listing if s.isDirectory())
    table = spark.createDataFrame([(r,) for r in repos], "repo string").repartition(max(1, len(repos)), "repo")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = _folder(root)
        for batch in batches:
            for repo in batch.column("repo").to_pylist():
                start = f"{base.rstrip('/')}/{repo}/"
                found = system.get_file_info(fs.FileSelector(start, recursive=True))
                rows = [(repo, f.path[len(start) :], f.size) for f in found if f.type == fs.FileType.File]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["repo", "path", "size"])

    files = table.mapInArrow(walk, "repo string, path string, size long")
    return files.select("repo", "path", extension(F.col("path")).alias("ext"), "size").filter(F.col("ext").isin(*wanted))


def write_source_files(src: DataFrame, root: str) -> None:
    """Write ``(repo, path, content)`` as files below ``root``, a folder that all tasks share.

    Tasks write side by side, with no step at the end that renames file by file in the driver.
    Files are spread by ``(repo, path)``; of rows equal in both, one stays.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _folder(root)
        made = set()
        for batch in batches:
            for repo, path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file = f"{base.rstrip('/')}/{repo}/{path}"
                folder = file.rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(file) as out:
                    out.write((content or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["files"])

    spread = src.select("repo", "path", "content").repartition(4 * src.sparkSession.sparkContext.defaultParallelism, "repo", "path")
    spread.mapInArrow(write, "files long").agg(F.sum("files")).collect()


def read_source_files(spark: SparkSession, root: str, extensions=None) -> DataFrame:
    """``(repo, path, ext, content)`` below ``root``; its first directories are the repos.

    Files are read in parallel, one row each; broken UTF-8 becomes the replacement character.
    Files that cannot be read are left out; ``unread_files`` tells which.
    """
    listed = list_source_files(spark, root, extensions).select("repo", "path", "ext")
    spread = listed.repartition(4 * spark.sparkContext.defaultParallelism, "repo", "path")

    names = ("repo", "path", "ext", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _folder(root)
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for repo, path, ext in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    with system.open_input_file(f"{base.rstrip('/')}/{repo}/{path}") as file:
                        content = file.read().decode("utf-8", "replace")
                except OSError:
                    continue
                held.append((repo, path, ext, content))
                size += len(content)
                if size >= _READ_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], names=names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], names=names)

    return spread.mapInArrow(read, "repo string, path string, ext string, content string")


def unread_files(listed: DataFrame, read: DataFrame) -> DataFrame:
    """``(repo, path, size)`` of the listed files that gave no row."""
    return listed.join(read.select("repo", "path"), ["repo", "path"], "left_anti").select("repo", "path", "size")


def _directories() -> Column:
    parts = F.split("path", "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def prune_dirs(df: DataFrame, pack: str = "detector") -> DataFrame:
    """Drop files below a directory that the pack's walker does not enter."""
    skip = F.array(*[F.lit(d) for d in SKIP_DIRS[pack]])
    keep = ~F.arrays_overlap(_directories(), skip)
    if pack not in ENTERS_HIDDEN:
        keep = keep & ~F.exists(_directories(), lambda d: d.startswith("."))
    return df.filter(keep)


def prune_ignored(df: DataFrame, prefixes, on: str = "dir") -> DataFrame:
    """Drop files whose directory (``on="dir"``) or own path (``"file"``) has a prefix.

    ``prefixes`` is a list for all repositories or a table ``(repo, prefix)``.
    """
    subject = F.col("path") if on == "file" else F.regexp_replace("path", "/?[^/]*$", "")
    if isinstance(prefixes, DataFrame):
        marked = df.withColumn("_subject", subject)
        table = prefixes.select(F.col("repo").alias("_repo"), "prefix").distinct()
        hit = (F.col("repo") == F.col("_repo")) & F.startswith("_subject", "prefix")
        return marked.join(table, hit, "left_anti").drop("_subject")
    for prefix in prefixes:
        df = df.filter(~subject.startswith(prefix))
    return df


def clean_pattern(pattern: str) -> str:
    """A pattern without stars and without one slash at either end."""
    text = pattern.replace("*", "")
    text = text[1:] if text.startswith("/") else text
    return text[:-1] if text.endswith("/") else text


def prune_glob(df: DataFrame, patterns: list[str]) -> DataFrame:
    """The editor's way: a pattern names a directory, by one or by several segments."""
    for pattern in patterns:
        parts = [p for p in clean_pattern(pattern).split("/") if p]
        if not parts:
            continue
        if len(parts) == 1:
            df = df.filter(~F.array_contains(_directories(), parts[0]))
            continue
        whole = "/".join(parts)
        folders = _directories()
        # every directory above the file, as a path
        paths = F.transform(
            folders, lambda d, i: F.array_join(F.slice(folders, F.lit(1), i + 1), "/")
        )
        ends = F.exists(paths, lambda p: p.endswith(whole))
        first, last = parts[0], parts[-1]
        # the last segment names a directory at or below the one that is called as the first
        at = F.array_position(folders, first)
        below = F.exists(
            F.transform(folders, lambda d, i: F.struct(d.alias("d"), i.alias("i"))),
            lambda s: (s["d"] == last) & (s["i"] + 1 >= at) & (at > 0),
        )
        df = df.filter(~(ends | below))
    return df


def language_column(path: Column, mode: str = "scan") -> Column:
    """``scan``, ``editor`` or ``infer`` (TypeScript or else JavaScript)."""
    ext = extension(path)
    if mode == "infer":
        return F.when(ext.isin(".ts", ".tsx"), "typescript").otherwise("javascript")
    table = EDITOR_EXTENSIONS if mode == "editor" else EXTENSIONS
    mapping = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(mapping, ext)


def language_of(df: DataFrame, mode: str = "scan") -> DataFrame:
    return df.withColumn("language", language_column(F.col("path"), mode))


def detect_languages(df: DataFrame) -> DataFrame:
    """Files per language and repository, most first; needs only the paths."""
    return (
        language_of(df.select("repo", "path"))
        .filter(F.col("language").isNotNull())
        .groupBy("repo", "language")
        .agg(F.count("*").alias("file_count"))
        .withColumn("pack_available", F.col("language").isin(*PACK_LANGUAGES))
        .orderBy("repo", F.desc("file_count"), "language")
    )


def select_packs(detected: DataFrame, requested: str = "auto") -> DataFrame:
    """``(repo, language, pack, has_pack)``; ``auto`` takes what was detected.

    TypeScript and JavaScript share a pack, which runs once per repository.
    """
    if requested == "auto":
        wanted = detected.select("repo", "language")
    else:
        names = F.array(*[F.lit(x.strip()) for x in requested.split(",")])
        wanted = detected.select("repo").distinct().withColumn("language", F.explode(names))
    pack = (
        F.when(F.col("language") == "python", "python_v1")
        .when(F.col("language").isin("typescript", "javascript"), "typescript_v1")
        .when(F.col("language") == "go", "go_v1")
    )
    return wanted.withColumn("pack", pack).withColumn("has_pack", pack.isNotNull())


def packs_to_run(selected: DataFrame) -> DataFrame:
    return selected.filter("has_pack").select("repo", "pack").distinct()
