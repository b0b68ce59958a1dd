"""Column expressions over repository paths, branches and titles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

REPO_ROOT = "(repo root)"
ILLEGAL = '/:*?"<>|'  # fixed value: characters that a stored file name may not hold

# File name extensions of binary content, by what the file is.
BINARY = (
    "png", "gif", "jpg", "jpeg", "bmp", "tif", "tiff", "webp", "avif", "ico", "svgz", "psd", "ai", "sketch", "fig",
    "mp3", "m4a", "wav", "flac", "ogg", "mp4", "m4v", "mov", "avi", "mkv", "webm",
    "zip", "gz", "tgz", "tar", "bz2", "xz", "zst", "7z", "rar",
    "jar", "war", "ear", "class", "aar", "apk", "whl", "egg", "gem", "nupkg", "deb", "rpm", "dmg", "pkg", "msi",
    "o", "a", "obj", "lib", "pdb", "so", "dylib", "dll", "exe", "rlib", "wasm", "node", "pyc", "pyo", "pyd", "beam",
    "parquet", "avro", "orc", "db", "sqlite", "sqlite3", "mdb",
    "pkl", "pickle", "npy", "npz", "h5", "hdf5", "onnx", "pt", "pth", "ckpt", "safetensors", "gguf", "bin",
    "pdf", "xls", "xlsx", "doc", "docx", "ppt", "pptx", "odt", "ods", "odp",
    "ttf", "otf", "woff", "woff2", "eot",
    "keystore", "jks", "p12", "pem", "crt", "cer", "der",
)
# Names of lock files, and ends of names of machine-made text.
LOCKS = (
    "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock", "Pipfile.lock", "uv.lock",
    "Gemfile.lock", "composer.lock", "go.sum", "mix.lock", "pubspec.lock", "packages.lock.json", "flake.lock",
)
MADE = (".min.js", ".min.css", ".js.map", ".css.map", ".ts.map")
# Fence languages by extension.
LANGUAGES = {
    "java": "java", "kt": "kotlin", "kts": "kotlin", "rs": "rust", "py": "python", "ts": "typescript", "tsx": "typescript",
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "go": "go", "rb": "ruby", "sh": "bash", "bash": "bash",
    "ml": "ocaml", "mli": "ocaml", "sql": "sql", "xml": "xml", "yml": "yaml", "yaml": "yaml", "json": "json", "zig": "zig",
}
# Fixed value: paths of tests (a test directory, or a file name's prefix, suffix or separated word).
TEST = r"(^|/)(test|tests|spec|specs|__tests__|testing)/|(^|/)[^/]*[a-z0-9.](Tests|Test|Spec)\.[^/.]*$|(^|/)[^/]*[._-](test|tests|spec)\.[^/.]*$|(^|/)[Tt]est_[^/]*\.[^/]*$|(^|/)[^/]+_SUITE\.[^/.]*$"


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dir_of(path: Column) -> Column:
    """The path before its last slash; empty without one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """After the name's last dot, case kept; null without one or if the name begins with its only dot."""
    name = basename(path)
    return F.when(name.rlike(r"^.+\."), F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def artifact(path: Column) -> Column:
    """Lower-case extension, for which a leading dot counts; the whole name if there is none."""
    name = basename(path)
    after = F.regexp_extract(name, r"\.([^.]*)$", 1)
    return F.lower(F.when(after == "", name).otherwise(after))


def grammar_extension(path: Column) -> Column:
    """As artifact, but null for a name without a dot."""
    name = basename(path)
    return F.when(name.contains("."), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def key_of(path: Column) -> Column:
    """(stem, module) by which declarations meet their consumers: the name without its last extension, and the first two directories (fewer if there are no more)."""
    return F.struct(stem(path).alias("stem"), group_of(path, 2).alias("module"))


def strip_md(path: Column) -> Column:
    return F.regexp_replace(path, r"\.md$", "")


def group_of(path: Column, depth: int) -> Column:
    """The first `depth` directories, fewer if there are no more; files at the root have a group of their own."""
    parts = F.split(path, "/")
    group = F.array_join(F.slice(parts, F.lit(1), F.least(F.size(parts) - 1, F.lit(depth))), "/")
    return F.when(group == "", REPO_ROOT).otherwise(group)


def module_of(path: Column, chains: tuple[str, ...] = ()) -> Column:
    """What comes before the first listed chain of directories, else src and the directory in it, else the first directory."""
    cases = [F.when(F.locate(f"/{c}/", path) > 0, F.substring(path, F.lit(1), F.locate(f"/{c}/", path) - 1)) for c in chains if c]
    at = F.locate("/src/", path)
    base, rest = F.substring(path, F.lit(1), at - 1), F.substring(path, at + 5, F.length(path))
    cases.append(F.when((at > 0) & rest.contains("/"), F.concat(base, F.lit("/src/"), F.substring_index(rest, "/", 1))).when(at > 0, base))
    cases.append(F.when(path.contains("/"), F.substring_index(path, "/", 1)))
    return F.coalesce(*cases, F.lit(REPO_ROOT))


def is_binary(path: Column) -> Column:
    return F.coalesce(extension(path).isin(*BINARY), F.lit(False))


def is_noise(path: Column) -> Column:
    name = basename(path)
    return reduce(lambda a, b: a | b, (name.endswith(s) for s in MADE), name.isin(*LOCKS))


def is_excluded(path: Column) -> Column:
    return is_binary(path) | is_noise(path)


#: POSIX bracket classes in Java's and RE2's common form; fixed values.
POSIX = {"alpha": "a-zA-Z", "digit": "0-9", "alnum": "a-zA-Z0-9", "upper": "A-Z", "lower": "a-z", "space": r"\s", "blank": r" \t", "xdigit": "0-9A-Fa-f", "punct": r"!-/:-@\[-`{-~"}


def posix(pattern: str) -> str:
    """An extended regular expression with its bracket classes spelt out."""
    for name, what in POSIX.items():
        pattern = pattern.replace(f"[:{name}:]", what)
    return pattern


def matches_any(path: Column, patterns: list[str]) -> Column:
    """Whether any pattern is found in the path; no patterns match nothing."""
    return path.rlike("|".join(f"(?:{posix(p)})" for p in patterns)) if patterns else F.lit(False)


def is_test(path: Column, pattern: str = TEST) -> Column:
    return path.rlike(pattern)


def language(path: Column, override: dict[str, str] | None = None) -> Column:
    """Fence language by extension, empty if unknown."""
    known = LANGUAGES | (override or {})
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.coalesce(F.element_at(table, F.regexp_extract(path, r"\.([^./]*)$", 1)), F.lit(""))


def repo_name(remote: Column) -> Column:
    """Last part of a remote, of either form, without .git."""
    bare = F.regexp_replace(remote, r"(.)/$", "$1")
    return F.regexp_replace(F.regexp_extract(bare, r"([^/:]*)$", 1), r"\.git$", "")


def sanitize(text: Column, mark: str) -> Column:
    return F.translate(text, ILLEGAL, mark * len(ILLEGAL))


def branch_name(branch: Column) -> Column:
    return sanitize(branch, "-")


def namespace(remote: Column, branch: Column) -> Column:
    return F.concat(repo_name(remote), F.lit("@"), branch_name(branch))


def file_title(title: Column) -> Column:
    return sanitize(title, "_")


def cluster_title(path: Column) -> Column:
    """Directories joined by dashes, each with its first letter in upper case and the rest as it is."""
    parts = F.transform(F.split(path, "/"), lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1_000_000)))
    return file_title(F.array_join(parts, " - "))


def short_commit(commit: Column) -> Column:
    return F.substring(commit, 1, 12)


def percent_encoded(path: Column) -> Column:
    """RFC 3986 unreserved characters and slashes stay, other bytes become %XX."""
    out = F.url_encode(path)
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def ancestors(path: Column) -> Column:
    """Directories above a path, the outermost first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.when(n < F.size(parts), F.array_join(F.slice(parts, F.lit(1), n), "/")))
