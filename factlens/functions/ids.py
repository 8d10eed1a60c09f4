"""Identity, path and name functions as Column expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factlens.schema import SPACES


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normal_path(path: Column | str) -> Column:
    return F.regexp_replace(_c(path), r"\\", "/")


def relative(path: Column | str, root: str) -> Column:
    """A path relative to ``root``; others keep their form."""
    p, base = normal_path(path), root.replace("\\", "/").rstrip("/") + "/"
    return F.when(p.startswith(base), F.substring(p, len(base) + 1, 1 << 30)).otherwise(p)


def slug(path: Column | str) -> Column:
    return F.regexp_replace(normal_path(path), r"[^a-zA-Z0-9_$/@.\-]", "_")


def module_id(path: Column | str) -> Column:
    return F.concat(F.lit("module:"), slug(path))


def is_external(path: Column | str) -> Column:
    p = normal_path(path)
    return p.contains("/node_modules/") | p.startswith("node_modules/") | p.startswith("../") | (p == "..")


def external_origin(path: Column | str) -> Column:
    """Package of the last node_modules segment (scoped names joined), the language library, or 'unknown'."""
    tail = F.element_at(F.split(normal_path(path), r"(?:^|/)node_modules/"), -1)
    package = F.regexp_extract(tail, r"^(@[^/]+/[^/]+|[^/]+)", 1)
    inside = normal_path(path).rlike(r"(?:^|/)node_modules/")
    lib = normal_path(path).rlike(r"(?:^|/)lib\.[^/]*d\.ts$")
    return F.when(inside & (package == "typescript") & lib, "typescript-lib").when(inside, package).when(lib, "typescript-lib").otherwise("unknown")


def entity_id(path: Column | str, name: Column | str) -> Column:
    return F.when(is_external(path), F.concat(F.lit("external:"), slug(external_origin(path)), F.lit(":"), _c(name))).otherwise(F.concat(F.lit("ts:"), slug(path), F.lit(":"), _c(name)))


def as_file(module: Column | str) -> Column:
    """The one key of modules: the bare path."""
    return F.regexp_replace(_c(module), r"^module:", "")


def last_segment(name: Column | str) -> Column:
    return F.substring_index(_c(name), ".", -1)


def name_roots(name: Column | str) -> Column:
    """A used name and its first segment."""
    return F.array_distinct(F.array(_c(name), F.substring_index(_c(name), ".", 1)))


def space(entity_type: Column | str) -> Column:
    table = F.create_map(*(F.lit(x) for kv in SPACES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, _c(entity_type)), F.lit("value"))


def confidence_bucket(confidence: Column | str) -> Column:
    return F.round(_c(confidence), 1)


def percent(part: Column | str, whole: Column | str) -> Column:
    """One decimal; null where the whole is 0."""
    return F.when(_c(whole) > 0, F.round(100.0 * _c(part) / _c(whole), 1))


def structure_id(structure: Column | str) -> Column:
    return F.concat(F.lit("struct:sha256:"), F.substring(F.sha2(_c(structure), 256), 1, 16))


def content_id(name: Column | str, structure: Column | str) -> Column:
    """Hash of the name as a JSON string, a NUL, and the structure."""
    quoted = F.regexp_replace(F.regexp_replace(_c(name), r"\\", r"\\\\"), '"', r'\\"')
    return F.concat(F.lit("content:sha256:"), F.substring(F.sha2(F.concat(F.lit('"'), quoted, F.lit('"'), F.lit("\x00"), _c(structure)), 256), 1, 16))


def body_fingerprint(structure: Column | str) -> Column:
    return F.substring(F.sha1(_c(structure)), 1, 16)


def import_candidates(specifier: Column | str) -> Column:
    """Ranked target paths of a relative specifier (first that exists wins); fixed values."""
    s = _c(specifier)
    js = lambda to: F.regexp_replace(s, r"\.js$", to)
    return F.array(js(".ts"), F.concat(s, F.lit(".ts")), js("/index.ts"), F.concat(s, F.lit("/index.ts")), js(".d.ts"), F.concat(js(""), F.lit("/index.ts")))


def resolve_path(directory: Column | str, relative_path: Column | str) -> Column:
    """``directory`` joined with a relative path, '.' and '..' removed."""
    parts = F.filter(F.split(F.concat(_c(directory), F.lit("/"), _c(relative_path)), "/"), lambda p: (p != "") & (p != "."))
    step = lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("")), acc), -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def directory(path: Column | str) -> Column:
    return F.regexp_replace(_c(path), r"/?[^/]*$", "")
