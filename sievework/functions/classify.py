"""Classification of files by path and first bytes: kind, origin and path signal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.text import ascii_lower, basename, case_transitions, entropy, extension, latin1

#: Bytes that decide the kind.
HEAD = 4096
# Extensions, magic numbers and weights by which existing results are reproduced.
SCRIPT_EXTENSIONS = ("js", "mjs")
PHP_EXTENSIONS = ("php", "phtml", "php5", "php7", "phar", "inc")
PLAIN_PHP_EXTENSIONS = ("php", "phtml", "inc", "phar")
IMAGE_EXTENSIONS = ("gif", "png", "jpg", "jpeg", "svg", "ico", "webp", "bmp")
ARCHIVE_MAGICS = ("504B0304", "504B0506", "504B0708", "1F8B08", "377ABCAF271C", "526172211A07")
PROGRAM_MAGICS = ("7F454C46", "4D5A", "2321")
SIGNAL_WEIGHTS = {
    "php_in_uploads": 60, "unknown_core_path": 60, "nested_same_dir": 50, "random_root_dir": 40, "mu_plugin_unknown": 30,
    "php_disguised": 40, "binary_in_content": 50, "fake_core_asset": 50, "stray_htaccess": 20,
}
SIGNAL_CAP = 100


def head_of(content: Column) -> Column:
    return F.substring(content, 1, HEAD)


def content_kind(head: Column, ext: Column) -> Column:
    """php, js, html, binary, archive or other, from the first bytes (binary) and the extension."""
    text, magic = latin1(head), F.hex(F.substring(head, 1, 8))
    is_php = ext.isin(*PHP_EXTENSIONS)
    starts = lambda values: F.lit(False) if not values else _any(magic.startswith(v) for v in values)
    archive = ~is_php & (starts(ARCHIVE_MAGICS) | text.rlike(r"\ABZh[1-9]") | (F.substring(text, 258, 5) == "ustar"))
    opens = ascii_lower(text).contains("<?php") | F.substring(text, 1, 64).contains("<?=")
    bare = F.regexp_replace(text, r"\s+", "")
    first = F.substring(bare, 1, 64)
    decoded = F.when(text.rlike(r"\A[A-Za-z0-9+/=\s]{64,}\z") & first.rlike(r"\A[A-Za-z0-9+/]*={0,2}\z"), latin1(F.try_to_binary(first, F.lit("base64"))))
    hidden = F.coalesce(ascii_lower(decoded).contains("<?php") | decoded.contains("<?="), F.lit(False))
    control = F.length(F.regexp_replace(text, r"[^\x00-\x08\x0E-\x1F\x7F]", ""))
    return (
        F.when(archive, "archive").when(opens | hidden, "php").when(starts(PROGRAM_MAGICS), "binary")
        .when(ascii_lower(text).rlike("<script|<html|<!doctype"), "html").when(ext.isin(*SCRIPT_EXTENSIONS), "js")
        .when(is_php, "php").when(control > 0.3 * F.length(text), "binary").otherwise("other")
    )


def _any(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out | c
    return out


def origin(path: Column, slugs: Column) -> Column:
    """core, plugin:slug, theme:slug, mu, uploads or other. ``slugs`` is the row's array of installed ``plugin:x`` and ``theme:x``."""
    path = F.ltrim(path, F.lit("/"))
    tag = lambda kind: F.concat(F.lit(f"{kind}:"), F.regexp_extract(path, rf"^wp-content/{kind}s/([^/]+)/", 1))
    inside = lambda kind: path.rlike(rf"^wp-content/{kind}s/[^/]+/")
    known = lambda kind: F.when(F.array_contains(slugs, tag(kind)), tag(kind)).otherwise("other")
    core = path.startswith("wp-admin/") | path.startswith("wp-includes/") | path.isin("index.php", "xmlrpc.php") | path.rlike(r"^wp-[^/]*\.php$")
    return (
        F.when(inside("plugin"), known("plugin")).when(inside("theme"), known("theme")).when(path.startswith("wp-content/mu-plugins/"), "mu")
        .when(path.startswith("wp-content/uploads/"), "uploads").when(core, "core").otherwise("other")
    )


def nested_same_dir(path: Column) -> Column:
    """A directory name stands three times in a row."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    three = lambda i: (F.get(dirs, i) != "") & (F.get(dirs, i) == F.get(dirs, i - 1)) & (F.get(dirs, i) == F.get(dirs, i - 2))
    return F.when(F.size(dirs) >= 3, F.exists(F.sequence(F.lit(2), F.size(dirs) - 1), three)).otherwise(F.lit(False))


def random_root_dir(path: Column) -> Column:
    """The first directory looks drawn at random."""
    root = F.substring_index(path, "/", 1)
    n = F.length(root)
    odd = F.when(n >= 8, ~root.rlike("(?i)[aeiou]") | (entropy(root) > 3.5)).when(n >= 5, case_transitions(root) >= 2).otherwise(False)
    return path.contains("/") & ~root.isin("wp-admin", "wp-includes", "wp-content") & odd


def signals(path: Column, origin_: Column, kind: Column, in_core: Column, known_good: Column) -> dict[str, Column]:
    """Each rule by name. ``in_core`` says whether the core checksum list has the path, null where there is no list."""
    ext, unknown = extension(path), F.coalesce(~in_core, F.lit(False))
    core_dir = path.startswith("wp-admin/") | path.startswith("wp-includes/")
    return {
        "php_in_uploads": (kind == "php") & (origin_ == "uploads"),
        "unknown_core_path": unknown & (origin_ == "core") & core_dir,
        "nested_same_dir": nested_same_dir(path),
        "random_root_dir": random_root_dir(path),
        "mu_plugin_unknown": (origin_ == "mu") & ~known_good,
        "php_disguised": (kind == "php") & ~ext.isin(*PLAIN_PHP_EXTENSIONS),
        "binary_in_content": kind.isin("binary", "archive") & path.startswith("wp-content/"),
        "fake_core_asset": unknown & path.rlike("^(wp-admin|wp-includes)/(.*/)?images/[^/]+$") & ext.isin(*IMAGE_EXTENSIONS),
        "stray_htaccess": (basename(path) == ".htaccess") & (path != ".htaccess") & ~path.startswith("wp-admin/") & ~path.startswith("wp-content/uploads/"),
    }


def path_signal(rules: dict[str, Column]) -> Column:
    """struct(score 0 to 100, reasons in rule order)."""
    score = sum((F.when(c, SIGNAL_WEIGHTS[k]).otherwise(0) for k, c in rules.items()), F.lit(0))
    reasons = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())
    return F.struct(F.least(score, F.lit(SIGNAL_CAP)).alias("score"), reasons.alias("reasons"))
