"""Readers for manifests and profiles that lie in text files."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): one row per file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def npm_packages(text: Column) -> Column:
    """(package, version) of the ``packages`` of a package-lock.json, as newer files have them; for older ones see ``nested_packages``."""
    return F.transform(
        F.map_entries(F.from_json(F.get_json_object(text, "$.packages"), "map<string,struct<version:string>>")),
        lambda e: F.struct(F.regexp_extract(e["key"], r"node_modules/((?:@[^/]+/)?[^/]+)$", 1).alias("package"), e["value"]["version"].alias("version")),
    )


#: Packages in a batch that leaves a task; it bounds what one large file takes at a time.
BATCH = 50_000


def _texts(column: list[str | None]) -> pa.Array:
    """Texts as Arrow has them; half a surrogate pair, which JSON may escape, becomes a question mark."""
    try:
        return pa.array(column, pa.string())
    except UnicodeEncodeError:
        return pa.array([None if x is None else x.encode("utf-8", "replace").decode() for x in column], pa.string())


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, package, version, depth) of batches of (path, value)."""

    def no_json(name: str) -> None:
        raise ValueError(name)

    reader, rows = json.JSONDecoder(parse_constant=no_json), []

    def batch() -> pa.RecordBatch:
        path, package, version, depth = zip(*rows) if rows else ((),) * 4
        rows.clear()
        return pa.RecordBatch.from_arrays([*map(_texts, (path, package, version)), pa.array(depth, pa.int32())], ["path", "package", "version", "depth"])

    for b in batches:
        for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            try:
                whole, _ = reader.raw_decode((text or "").lstrip(" \t\r\n"))
            except (ValueError, RecursionError):
                continue
            below = [(whole["dependencies"], 0)] if isinstance(whole, dict) and "dependencies" in whole else []
            while below:
                deps, depth = below.pop()
                for package, entry in deps.items() if isinstance(deps, dict) else [(None, e) for e in deps] if isinstance(deps, list) else ():
                    version = None
                    if isinstance(entry, dict):
                        version = entry.get("version")
                        if not (version is None or isinstance(version, str)):
                            version = json.dumps(version, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
                        if "dependencies" in entry:
                            below.append((entry["dependencies"], depth + 1))
                    rows.append((path, package, version, depth))
                    if len(rows) == BATCH:
                        yield batch()
    yield batch()


def nested_packages(files: DataFrame) -> DataFrame:
    """(path, package, version, depth) of lock files (path, value) whose ``dependencies`` nest.

    A text is read once, by the task that has it, and opened down to its last level; nothing is written between levels. What is no JSON, nests
    deeper than Python reads (some thousand levels), or has no dependencies, gives nothing; a package without a version has a null one.
    """
    return files.select("path", "value").mapInArrow(_opened, "path string, package string, version string, depth int")


def yarn_packages(text: Column) -> Column:
    """(package, version) of a yarn.lock: an entry's head line and the version line below it."""
    heads = F.regexp_extract_all(text, F.lit(r'(?m)^"?((?:@[^/@\s"]+/)?[^@\s",]+)@[^\n]*:\n\s+version "?([^"\n]+)"?'), F.lit(0))
    return F.transform(
        heads,
        lambda s: F.struct(F.regexp_extract(s, r'^"?((?:@[^/@\s"]+/)?[^@\s",]+)@', 1).alias("package"), F.regexp_extract(s, r'version "?([^"\n]+)"?', 1).alias("version")),
    )


def pnpm_packages(text: Column) -> Column:
    """(package, version) of a pnpm-lock.yaml.

    A package is a key at two spaces: name and version with ``@`` between them (``/`` in older files), what peers it was built for in
    brackets behind, perhaps in quotes and after a slash.
    """
    keys = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^ {2}(\S[^\n]*):[ \t]*$"), F.lit(1)), lambda k: F.ltrim(F.substring_index(F.trim(k, F.lit("'")), "(", 1), F.lit("/")))
    cut = lambda k: F.length(k) - F.greatest(F.locate("@", F.reverse(k)), F.locate("/", F.reverse(k)))
    at = lambda k: F.when(F.locate("@", F.reverse(k)).between(1, F.length(k) - 1), F.length(k) - F.locate("@", F.reverse(k))).otherwise(cut(k))
    named = F.transform(keys, lambda k: F.struct(k.substr(F.lit(1), at(k)).alias("package"), k.substr(at(k) + 2, F.length(k)).alias("version")))
    return F.filter(named, lambda p: p["version"].rlike(r"^\d"))


#: Fixed value: the flag of a bad version.
COMPROMISED = "!!COMPROMISED!!"
#: Kind of lock file -> its packages.
LOCKS = {"package-lock.json": npm_packages, "yarn.lock": yarn_packages, "pnpm-lock.yaml": pnpm_packages}


def locked(files: DataFrame) -> DataFrame:
    """(repo, package, version) of lock files (path, value); the last part of a path is the repo, two underscores and the kind."""
    name = F.element_at(F.split("path", "/"), -1)
    repo, kind = F.substring_index(name, "__", 1), F.substring_index(name, "__", -1)
    packages = F.coalesce(*[F.when(kind == k, f(F.col("value"))) for k, f in LOCKS.items()])
    each = files.select(repo.alias("repo"), F.explode(packages).alias("p")).select("repo", "p.package", "p.version").where("package <> ''")
    older = files.where((kind == "package-lock.json") & F.get_json_object("value", "$.packages").isNull())
    nested = nested_packages(older.select(repo.alias("path"), "value")).select(F.col("path").alias("repo"), "package", "version")
    return each.unionByName(nested)


#: Kinds of lock file and tools that a scan of manifests tells: fixed values.
LOCK_NAMES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "bun.lock", "npm-shrinkwrap.json")
TOOLS = (("vite", "vite"), ("webpack", "webpack"), ("next", "next"), ("@sveltejs/kit", "sveltekit"), ("react-scripts", "CRA"), ("typescript", "ts"))


#: Where npm takes a dependency from that is no version of the registry: a repository by its address, a tarball, or a host's short form. Fixed values.
ADDRESSES = ("git://", "git+ssh://", "git+http://", "git+https://", "git+file://", "http://", "https://")
HOSTS = ("github:", "gitlab:", "bitbucket:", "gist:")


def not_registry(spec: Column) -> Column:
    """Whether npm reads a dependency's value as a repository or tarball: an address, a host's short form, ``user@host:path``, or ``owner/name``."""
    known = reduce(lambda a, b: a | b, [spec.startswith(x) for x in (*ADDRESSES, *HOSTS)])
    owner = spec.rlike(r"^[A-Za-z0-9-]+/[A-Za-z0-9._-]+(#.*)?$")
    return known | owner | spec.rlike(r"^[A-Za-z0-9_.-]+@[A-Za-z0-9.-]+:")


def posture(files: DataFrame) -> DataFrame:
    """(repo, lockfiles, manager, tools, workflows, git_deps) of repositories' files (repo, path, value), for those with a package.json at the top.

    Lists are joined by commas in order of name; git_deps are dependencies that a git or web address stands for.
    """
    top = ~F.col("path").contains("/")
    manifest = F.max(F.when(F.col("path") == "package.json", F.col("value")))
    locks = F.array_join(F.sort_array(F.collect_set(F.when(top & F.col("path").isin(*LOCK_NAMES), F.col("path")))), ",")
    flows = F.count_if(F.col("path").startswith(".github/workflows/"))
    g = files.groupBy("repo").agg(manifest.alias("m"), locks.alias("lockfiles"), flows.alias("workflows")).where("m is not null")
    deps = lambda c: F.coalesce(F.from_json(F.get_json_object("m", f"$.{c}"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    every = F.concat(F.map_entries(deps("dependencies")), F.map_entries(deps("devDependencies")))
    g = g.select("repo", "lockfiles", "workflows", F.get_json_object("m", "$.packageManager").alias("manager"), every.alias("deps"), F.get_json_object("m", "$.scripts.build").alias("build"))
    keys = F.transform("deps", lambda d: d["key"])
    tools = F.array_compact(F.array(F.when(F.coalesce("build", F.lit("")) != "", F.lit("build")), *[F.when(F.array_contains(keys, n), F.lit(t)) for n, t in TOOLS]))
    git = F.transform(F.filter("deps", lambda d: not_registry(d["value"])), lambda d: d["key"])
    return g.select("repo", "lockfiles", F.coalesce("manager", F.lit("")).alias("manager"), F.array_join(tools, "|").alias("tools"), "workflows", F.array_join(F.array_sort(F.array_distinct(git)), ",").alias("git_deps"))


def flagged(locks: DataFrame, bad: DataFrame) -> DataFrame:
    """(repo, package, versions, flag) for the packages of ``bad`` (package, version); ``locks``: (repo, package, version)."""
    hit = locks.join(bad.withColumnRenamed("version", "bad_version"), "package")
    return hit.groupBy("repo", "package").agg(
        F.array_join(F.sort_array(F.collect_set("version")), ",").alias("versions"),
        F.when(F.max((F.col("version") == F.col("bad_version")).cast("int")) == 1, COMPROMISED).otherwise("OK").alias("flag"),
    )


#: Fixed value: mean bytes between samples, by which sampled sizes are scaled up.
RATE = 2_097_152


def heap_stacks(files: DataFrame) -> DataFrame:
    """(path, stack array<string>, n, bytes) of heap profiles (path, value), one row per stack with something live.

    A profile's first section has a line of ``@`` and addresses for each stack; the line under it, named ``t*``, holds the live count and bytes.
    """
    section = F.substring_index("value", "MAPPED_LIBRARIES:", 1)
    entry = F.lit(r"(?m)^@((?:[ \t]+\S+)+)[ \t]*\n[ \t]+t\*:[ \t]*(\d+):[ \t]*(\d+)")
    part = lambda k: F.regexp_extract_all(section, entry, F.lit(k))
    each = files.select("path", F.explode(F.arrays_zip(part(1).alias("at"), part(2).alias("n"), part(3).alias("size"))).alias("e"))
    return each.select("path", F.split(F.trim("e.at"), r"\s+").alias("stack"), F.col("e.n").cast("long").alias("n"), F.col("e.size").cast("long").alias("bytes")).where("n > 0 and bytes > 0")


def mapped_ranges(files: DataFrame) -> DataFrame:
    """(path, start, end, offset, library) of the executable ranges in a profile's second section; numbers are longs."""
    section = F.substring_index("value", "MAPPED_LIBRARIES:", -1)
    line = F.lit(r"(?m)^([0-9a-f]+)-([0-9a-f]+)[ \t]+\S*x\S*[ \t]+([0-9a-f]+)[ \t]+\S+[ \t]+\S+[ \t]+(/\S+)")
    part = lambda k: F.regexp_extract_all(section, line, F.lit(k))
    each = files.select("path", F.explode(F.arrays_zip(*[part(k).alias(n) for k, n in enumerate(("start", "end", "offset", "library"), 1)])).alias("e"))
    number = lambda c: F.conv(F.col(f"e.{c}"), 16, 10).cast("long").alias(c)
    return each.select("path", number("start"), number("end"), number("offset"), "e.library")


def scaled(n: Column, size: Column, rate: int = RATE) -> Column:
    """Bytes that sampled bytes stand for."""
    return size / (1 - F.exp(-(size / n) / rate))


def profile_difference(base: DataFrame, new: DataFrame) -> DataFrame:
    """(stack, delta): live bytes of the new profile less those of the base."""
    total = lambda d, c: d.groupBy("stack").agg(F.sum(scaled(F.col("n"), F.col("bytes"))).alias(c))
    d = total(new, "b").join(total(base, "a"), "stack", "full")
    return d.select("stack", (F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0))).alias("delta")).where("delta <> 0")


def resolve(redirects: dict[str, str], name: str) -> str:
    """The table that stands in for ``name``, if a run redirects it."""
    return redirects.get(name, name)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def to_dot(edges: list[tuple[str, str]], name: str = "metrics", colours: dict[str, str] | None = None) -> str:
    """A small graph in the DOT language, nodes filled by ``colours``; several joined by commas are stripes."""
    quoted = lambda x: '"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"'
    styles = {n: ("wedged" if "," in c else "filled", c.replace(",", ":")) for n, c in (colours or {}).items()}
    nodes = "".join(f"  {quoted(n)} [style={s}, fillcolor={quoted(c)}];\n" for n, (s, c) in sorted(styles.items()))
    body = "".join(f"  {quoted(a)} -> {quoted(b)};\n" for a, b in sorted(edges))
    return f"digraph {name} {{\n{nodes}{body}}}\n"
