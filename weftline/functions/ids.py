"""Column expressions over node ids, references and paths; all of them stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE = "struct<kind:string,target:string,scope:string,type:string,slug:string,display:string,type_guess:string,descriptor:string>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """``c`` without leading and trailing Unicode white space (``trim`` alone knows the blank only)."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def words(c: Column | str) -> Column:
    """The white-space separated words of ``c``; no words for blank text."""
    return F.filter(F.split(_col(c), r"(?U)\s+"), lambda w: w != "")


def id_scope(c: Column | str) -> Column:
    """What stands before the last ``/`` of an id, null where there is nothing."""
    found = F.regexp_extract(_col(c), r"(?s)^(.+)/[^/]*$", 1)
    return F.when(found != "", found)


def local_id(c: Column | str) -> Column:
    """``type:slug`` of an id, without its scope."""
    c = _col(c)
    return F.when(id_scope(c).isNotNull(), F.substring_index(c, "/", -1)).otherwise(c)


#: A well-formed id: scope, type, slug. One match reads all of it, which keeps generated code small.
ID = r"(?s)^(?:(.+)/)?(/?[^/:]+):([^/]+)$"


def _group(c: Column | str, n: int) -> Column:
    return F.nullif(F.regexp_extract(_col(c), ID, n), F.lit(""))


def id_type(c: Column | str) -> Column:
    """The type of a well-formed id, else null."""
    return _group(c, 2)


def id_slug(c: Column | str) -> Column:
    """The slug of a well-formed id (it may hold further colons), else null."""
    return _group(c, 3)


def parse_id(c: Column | str) -> Column:
    """``struct<scope, type, slug>`` of an id; null where it is malformed."""
    return F.when(_col(c).rlike(ID), F.struct(_group(c, 1).alias("scope"), _group(c, 2).alias("type"), _group(c, 3).alias("slug")))


def id_error(c: Column | str) -> Column:
    """Why an id is malformed, null where it is well-formed."""
    last = local_id(c)
    return (
        F.when(~last.contains(":"), F.lit("id is missing a ':' type prefix"))
        .when(last.startswith(":"), F.lit("id has an empty type prefix"))
        .when(last.endswith(":") & (F.length(F.regexp_replace(last, "[^:]", "")) == 1), F.lit("id has an empty slug"))
    )


def format_id(scope: Column | str, node_type: Column | str, slug: Column | str) -> Column:
    """The canonical text of an id."""
    local = F.concat(_col(node_type), F.lit(":"), _col(slug))
    return F.when(_col(scope).isNotNull(), F.concat(_col(scope), F.lit("/"), local)).otherwise(local)


#: What stands in ``[[ ]]``, outer white space removed: a loose end, or an id with an optional display text.
LOOSE = r"(?s)^\?([^:]*):(.*)$"
LINK = r"(?s)^([^|]*)(?:(\|)(.*))?$"


def parse_reference(c: Column | str) -> Column:
    """The reference inside ``[[ ]]``: kind ``resolved`` with target and display, ``unresolved`` with guess and descriptor,
    or null for text that is no reference."""

    def read(inner: Column) -> Column:
        none = F.lit(None).cast("string")
        part = lambda pattern, n: trimmed(F.regexp_extract(inner, pattern, n))
        names = ("kind", "target", "scope", "type", "slug", "display", "type_guess", "descriptor")
        shape = lambda *cells: F.struct(*(x.alias(n) for n, x in zip(names, cells, strict=True)))
        loose = shape(F.lit("unresolved"), none, none, none, none, none, F.nullif(part(LOOSE, 1), F.lit("")), part(LOOSE, 2))
        display = F.when(F.regexp_extract(inner, LINK, 2) == "|", part(LINK, 3))
        target = part(LINK, 1)
        link = shape(F.lit("resolved"), target, _group(target, 1), _group(target, 2), _group(target, 3), display, none, none)
        return F.when(inner.startswith("?"), F.when(part(LOOSE, 2) != "", loose)).when(target.rlike(ID), link)

    # a one-element array binds the trimmed text, which is then read several times
    return F.transform(F.array(trimmed(c)), read)[0]


def render_link(display: Column | str, name: Column | str, href: Column | str) -> Column:
    """``[display or name](href)``; an empty display is kept."""
    return F.concat(F.lit("["), F.coalesce(_col(display), _col(name)), F.lit("]("), _col(href), F.lit(")"))


def reference_value(c: Column | str) -> Column:
    """A frontmatter value without stray brackets around it."""
    inner = trimmed(c)
    return F.when(inner.startswith("[[") & inner.endswith("]]") & (F.length(inner) >= 4), trimmed(inner.substr(F.lit(3), F.length(inner) - 4))).otherwise(inner)


def referenced_type(c: Column | str) -> Column:
    """The type of a reference-shaped value - ``type:slug`` without white space and with a clean type - else null."""
    found = F.regexp_extract(reference_value(c), r"(?U)^([A-Za-z0-9_\-]+):\S+$", 1)
    return F.when(found.rlike(r"^[A-Za-z0-9_\-]+$"), found)


def file_stem(path: Column | str) -> Column:
    """The file name without its last extension."""
    name = F.substring_index(_col(path), "/", -1)
    stem = F.regexp_extract(name, r"(?s)^(.+)\.[^.]*$", 1)
    return F.when(stem != "", stem).otherwise(name)


def relative_path(source: Column | str, target: Column | str) -> Column:
    """The path of file ``target`` seen from the folder of file ``source``: ``./x`` below it, ``../x`` beside or above."""

    def walk(p: Column) -> Column:
        a, b = p["a"], p["b"]
        folder = lambda v: F.slice(v, 1, F.size(v) - 1)
        differs = F.array_position(F.zip_with(folder(a), folder(b), lambda x, y: F.coalesce(x == y, F.lit(False))), False)
        common = F.when(differs == 0, F.size(a) - 1).otherwise(differs - 1).cast("int")
        ups = F.size(a) - 1 - common
        rest = F.array_join(F.slice(b, common + 1, F.size(b)), "/")
        return F.concat(F.when(ups == 0, F.lit("./")).otherwise(F.repeat(F.lit("../"), ups)), rest)

    return F.transform(F.array(F.struct(F.split(_col(source), "/").alias("a"), F.split(_col(target), "/").alias("b"))), walk)[0]
