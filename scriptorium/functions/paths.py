"""Predicates and parts of file paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: endings by class, secret-file patterns, folders that hold no documents
ENDINGS = {
    "document": (".md", ".txt", ".rst"),
    "paper": (".pdf",),
    "office": (".docx", ".doc", ".xlsx", ".xls", ".pptx"),
    "image": (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg"),
    "video": (".mp4", ".mov", ".webm", ".mkv", ".avi", ".m4v", ".mp3", ".wav", ".m4a", ".ogg"),
}
SECRETS = (
    r"(?i)(^|[\\/])\.(env|envrc)(\.|$)",
    r"(?i)\.(pem|key|p12|pfx|cert|crt|der|p8)$",
    r"(?i)(credential|secret|passwd|password|token|private_key)",
    r"(id_rsa|id_dsa|id_ecdsa|id_ed25519)(\.pub)?$",
    r"(?i)(\.netrc|\.pgpass|\.htpasswd)$",
)
CLOUD_SECRETS = r"(?i)(aws_credentials|gcloud_credentials|service.account)"
SKIPPED = ("node_modules", "__pycache__", ".git", ".svn", ".hg", "venv", ".venv", "dist", "build", ".eggs")
SKIPPED_WIDE = (
    "venv", ".venv", "env", ".env", "node_modules", "__pycache__", ".git", "dist", "build", "target", "out", "site-packages", "lib64",
    ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".eggs", "*.egg-info",
)
SKIPPED_FILES = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock", "Gemfile.lock", "composer.lock", "go.sum", "go.work.sum",
)
PAPER_SIGNALS = (
    r"(?i)\barxiv\b", r"(?i)\bdoi\s*:", r"(?i)\babstract\b", r"(?i)\bproceedings\b", r"(?i)\bjournal\b", r"(?i)\bpreprint\b",
    r"\\cite\{", r"\[\d+\]", r"\[\n\d+\n\]", r"(?i)eq\.\s*\d+|equation\s+\d+", r"\d{4}\.\d{4,5}", r"(?i)\bwe propose\b", r"(?i)\bliterature\b",
)


def name_of(path: Column | str) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem_of(path: Column | str) -> Column:
    """The name without its last ending; a leading dot is no ending."""
    return F.regexp_replace(name_of(path), r"(?<=.)\.[^.]*$", "")


def ending_of(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(name_of(path), r"[^.].*(\.[^.]+)$", 1))


def file_class(path: Column | str) -> Column:
    """document, paper, office, image or video by the ending; else null."""
    out = F.lit(None).cast("string")
    for kind, endings in ENDINGS.items():
        out = F.when(ending_of(path).isin(list(endings)), kind).otherwise(out)
    return out


def is_secret(path: Column | str, cloud: bool = False) -> Column:
    out = F.lit(False)
    for p in SECRETS + ((CLOUD_SECRETS,) if cloud else ()):
        out = out | F.col(path).rlike(p) if isinstance(path, str) else out | path.rlike(p)
    return out


def is_skipped(path: Column | str) -> Column:
    """Whether the file is one that tools generate."""
    return name_of(path).isin(list(SKIPPED_FILES))


def in_noise(path: Column | str, wide: bool = False) -> Column:
    """Whether a folder of the path is hidden, a cache, an environment or build output."""
    parts = F.split(path, r"[/\\]")
    return F.exists(parts, lambda p: p.isin(list(SKIPPED_WIDE if wide else SKIPPED)) | (p.startswith(".") & ~p.isin(".", "..", "")) | p.endswith("_venv") | p.endswith("_env") | p.endswith(".egg-info"))


def paper_signals(text: Column | str) -> Column:
    """How many of the signs of an academic paper are in the first 3000 characters."""
    head = F.substring(text, 1, 3000)
    return sum((head.rlike(p).cast("int") for p in PAPER_SIGNALS), F.lit(0))


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression."""
    out, k = "", 0
    while k < len(pattern):
        ch = pattern[k]
        if ch == "*":
            out += ".*"
        elif ch == "?":
            out += "."
        elif ch == "[" and "]" in pattern[k + 2 :]:
            end = pattern.index("]", k + 2)
            body = pattern[k + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            k = end
        else:
            out += "\\" + ch if not ch.isalnum() else ch
        k += 1
    return "(?s)^(?:" + out + ")$"


def _like(pattern: str):
    return lambda x: x.rlike(pattern)


def is_ignored(path: Column | str, patterns: list[str | tuple[str, str]]) -> Column:
    """Whether an ignore pattern matches the path, its name, a part of it or a prefix of it. A
    pattern may come with the folder its file stands in; then the path is also taken from
    that folder on, if it lies below it."""
    whole = F.regexp_replace(F.col(path) if isinstance(path, str) else path, "^file:/+", "/")
    out = F.lit(False)
    for anchor, p in ((("", x) if isinstance(x, str) else x) for x in patterns):
        p = p.strip().strip("/")
        if not p or p.startswith("#"):
            continue
        c, rx, anchor = whole, glob_regex(p), anchor.rstrip("/") + "/"
        if anchor != "/":
            c = F.when(whole.startswith(anchor), F.substring(whole, len(anchor) + 1, 1 << 20)).otherwise(whole)
            out = out | whole.rlike(rx)
        parts = F.split(c, "/")
        prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
        out = out | c.rlike(rx) | F.exists(parts, _like(rx)) | F.exists(prefixes, _like(rx))
    return out


def safe_url(url: Column | str) -> Column:
    """http or https, and no metadata, loopback, private, shared or link-local host. Addresses in
    numbers are allowed only in plain dotted decimals: whole, octal, hexadecimal and
    shortened ones and those of version 6 that hold one of version 4 are refused."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    local = host.rlike(r"^(localhost\.?$|.*\.localhost\.?$|127\.|10\.|0\.|169\.254\.|192\.168\.|192\.0\.0\.|198\.1[89]\.|172\.(1[6-9]|2\d|3[01])\.|100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|2(2[4-9]|[3-5]\d)\.)")
    local = local | host.rlike(r"^\[(::|f[cdef]|64:ff9b:|2002:|.*::ffff:|.*\.)") | host.isin("metadata.google.internal", "metadata")
    number = host.rlike(r"^(0x[0-9a-f]*|\d+)(\.(0x[0-9a-f]*|\d+))*\.?$")
    dotted = host.rlike(r"^(0|[1-9]\d{0,2})(\.(0|[1-9]\d{0,2})){3}$")
    return scheme.isin("http", "https") & (host != "") & ~local & (~number | dotted)


# fixed values: endings of code
CODE = (
    ".py", ".ts", ".js", ".jsx", ".tsx", ".mjs", ".ejs", ".go", ".rs", ".java", ".cpp", ".cc", ".cxx", ".c", ".h", ".hpp", ".rb", ".swift",
    ".kt", ".kts", ".cs", ".scala", ".php", ".lua", ".toc", ".zig", ".ps1", ".ex", ".exs", ".m", ".mm", ".jl", ".vue", ".svelte", ".dart", ".v", ".sv",
)
ASSETS = (".xcassets", ".imageset")


def content_class(path: Column | str, text: Column) -> Column:
    """code, paper, image, document or video: a text with three signs of a paper is one, a pdf
    among an application's assets is none."""
    c = F.col(path) if isinstance(path, str) else path
    end = ending_of(c)
    asset = F.exists(F.split(c, r"[/\\]"), lambda p: p.endswith(ASSETS[0]) | p.endswith(ASSETS[1]))
    plain = end.isin(list(ENDINGS["document"]))
    return (
        F.when(name_of(c).endswith(".blade.php"), "code").when(end.isin(list(CODE)), "code").when(end.isin(list(ENDINGS["paper"])), F.when(~asset, "paper")).when(end.isin(list(ENDINGS["image"])), "image")
        .when(plain & (F.coalesce(paper_signals(text), F.lit(0)) >= 3), "paper").when(plain | end.isin(".docx", ".xlsx"), "document")
        .when(end.isin(list(ENDINGS["video"])), "video")
    )


def sidecar(path: Column | str) -> Column:
    """The name of the markdown beside a converted file: its stem and eight digits of its path's hash."""
    c = F.col(path) if isinstance(path, str) else path
    return F.concat(stem_of(c), F.lit("_"), F.substring(F.sha2(c, 256), 1, 8), F.lit(".md"))
