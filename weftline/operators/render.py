"""Nodes as portable Markdown: links become relative Markdown links, loose ends their descriptors.

Batched: all documents asked for are rendered together. Link targets are resolved in one redirect closure over the
distinct targets and come back as one small map a document, so the text itself is never shuffled.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.config import Config
from weftline.functions import ids
from weftline.operators.graph import resolve_all
from weftline.operators.parse import is_fence, lines_of, split_document

LINK = re.compile(r"\[\[(.*?)\]\]")


def rewrite_links(text: str, links: dict[str, str]) -> str:
    """``text`` with every ``[[inner]]`` of its prose replaced by ``links[inner]``; unknown ones and fences stay."""
    parts = split_document(text)
    lines = lines_of(text)
    head = lines[: parts[2] - 1] if parts else []
    out, fenced = list(head), False
    for line in lines[len(head) :]:
        if is_fence(line):
            fenced = not fenced
        elif not fenced and "[[" in line:
            line = LINK.sub(lambda m: links.get(m[1], m[0]), line)
        out.append(line)
    return "\n".join(out) + "\n"


def prose_links(documents: DataFrame) -> DataFrame:
    """``(path, inner)``: the distinct link texts of documents' prose, outside fences."""

    @F.pandas_udf("array<string>")
    def inner(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[str]:
            parts = split_document(text or "")
            found, fenced = {}, False
            for line in parts[1] if parts else lines_of(text or ""):
                if is_fence(line):
                    fenced = not fenced
                elif not fenced:
                    found.update(dict.fromkeys(LINK.findall(line)))
            return list(found)

        return texts.map(one)

    return documents.select("path", F.explode(inner("content")).alias("inner"))


def link_texts(nodes: DataFrame, links: DataFrame, config: Config) -> DataFrame:
    """``(path, inner, text)``: what each link of ``links (path, scope, inner)`` is replaced by; dangling ones are left out."""
    rows = links.withColumn("ref", ids.parse_reference("inner")).where("ref IS NOT NULL")
    loose = rows.where(F.col("ref.kind") == "unresolved").select("path", "inner", F.col("ref.descriptor").alias("text"))
    relative = F.col("ref.type").isin(*config.scoped_types) & F.col("ref.scope").isNull() & F.col("scope").isNotNull() if config.scoped_types else F.lit(False)
    target = F.when(relative, ids.format_id("scope", "ref.type", "ref.slug")).otherwise(F.col("ref.target"))
    linked = rows.where(F.col("ref.kind") == "resolved").select("path", "inner", target.alias("target"), F.col("ref.slug").alias("slug"), F.col("ref.display").alias("display"))
    ends = resolve_all(nodes, linked.select(F.col("target").alias("id"))).where("resolved IS NOT NULL").select(F.col("requested").alias("target"), "resolved")
    there = nodes.select(F.col("id").alias("resolved"), F.col("path").alias("to_path"), "name")
    known = linked.join(ends, "target").join(there, "resolved")
    text = ids.render_link("display", F.coalesce("name", "slug"), ids.relative_path("path", "to_path"))
    return known.select("path", "inner", text.alias("text")).unionByName(loose)


def render(nodes: DataFrame, documents: DataFrame, requested: DataFrame, config: Config) -> DataFrame:
    """``id path markdown`` of every requested id that stands for a node (redirects followed), each node once."""
    ends = resolve_all(nodes, requested).where("resolved IS NOT NULL").select(F.col("resolved").alias("id")).distinct()
    wanted = nodes.join(ends, "id", "left_semi").select("id", "path", ids.id_scope("id").alias("scope"))
    texts = documents.join(wanted, "path").select("id", "path", "scope", "content")
    links = prose_links(texts).distinct().join(texts.select("path", "scope").distinct(), "path")
    replaced = link_texts(nodes, links, config).groupBy("path").agg(F.map_from_entries(F.collect_set(F.struct("inner", "text"))).alias("links"))

    @F.pandas_udf("string")
    def rewrite(content: pd.Series, links: pd.Series) -> pd.Series:
        return pd.Series([rewrite_links(c or "", dict(m) if m is not None else {}) for c, m in zip(content, links, strict=True)], dtype="object")

    return texts.join(replaced, "path", "left").select("id", "path", rewrite("content", "links").alias("markdown"))
