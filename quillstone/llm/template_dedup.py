"""Line dedup with a log-template tree.

Every line of every text is parsed into a tree of fixed depth: first by its number of tokens, then
by its leading ``depth`` tokens.  Tokens that hold a digit are variable fields and are written
``<*>`` from the start.  Lines of ``long_tokens`` tokens or more recur from ``long_docs`` different
texts on: so many words are not met twice by chance.  Shorter lines, of one token too, need
``min_docs``.  All lines of a leaf are of one length, so need the same number.  In a leaf, a token
is kept at its position if at least so many different texts have it there, else it is a variable field too; a line whose kept tokens make up
at least ``similarity`` of it is generalised to that template, any other line stays its own
template.  A template that recurs in at least so many different texts is dropped from every
text but the first that has it (least doc_id, then text hash), so nothing leaves the corpus
altogether.

"Different texts": exact copies of a document count once; whole copies are the business of
near-duplicate stages, not of line dedup.

Only hashes are shuffled at first: (leaf, line, text).  The tokens of a line are fetched again
only where a leaf recurs but the line alone doesn't.  All counts are grouped aggregates with
partial sums, so a line, leaf or text of any frequency is never one group in one task.  What meets
the texts again (which lines to fetch, which to drop) is broadcast up to ``broadcast_bytes``, as
counted; beyond it the texts are shuffled by their hash, where adaptive execution splits the
partition of a text with very many copies.

Edge cases: a null text stays null and counts as empty; blank lines are never dropped (nor
lines of fewer than ``min_tokens`` tokens, where that is set above one); a line that occurs more than once in its first text stays
there each time; repeated rows are treated alike; rows without doc_id come after all others when
the first text is chosen; a text all of whose lines are dropped is empty.  Other columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize

_DIGITS = frozenset("0123456789")
_DIGIT = re.compile("[0-9]")
WILD = "<*>"


@dataclass(frozen=True)
class TemplateParams:
    min_docs: int = 5
    depth: int = 3
    similarity: float = 0.6
    min_tokens: int = 1
    long_tokens: int = 20
    long_docs: int = 2
    broadcast_bytes: int = 64 << 20


def _small(df: DataFrame, row: int, p: TemplateParams, array: str | None = None, item: int = 0) -> DataFrame:
    """``df``, to be broadcast if it is small as counted: ``row`` bytes a row, ``item`` for each element of ``array``."""
    items = F.coalesce(F.sum(F.size(array)), F.lit(0)) if array else F.lit(0)
    rows, items = df.agg(F.count("*"), items).first()
    return F.broadcast(df) if rows * row + items * item <= p.broadcast_bytes else df


def masked(line: str) -> list[str]:
    """The tokens of a line, those with a digit as variable fields."""
    tokens = line.split()
    if not _DIGIT.search(line):
        return tokens
    return [WILD if not _DIGITS.isdisjoint(t) else t for t in tokens]


def keys(tokens: list[str], depth: int) -> tuple[int, int]:
    """``(leaf, line)``: signed 64-bit hashes of the tree path and of the masked line."""
    leaf = f"{len(tokens)}\x1f" + "\x1f".join(tokens[:depth])
    whole = " ".join(tokens)
    a = xxhash.xxh3_64_intdigest(leaf.encode("utf-8", "surrogatepass"))
    b = xxhash.xxh3_64_intdigest(whole.encode("utf-8", "surrogatepass"))
    return a - (a >> 63 << 64), b - (b >> 63 << 64)


def _lines(docs: DataFrame, p: TemplateParams) -> DataFrame:
    """``doc_id, th, at, leaf, line, need, twin`` of every line that may be dropped; ``need``: texts from which on it recurs;
    ``twin``: does the text have another line of the leaf?"""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, hashes, ats, leaves, lines, needs, twins = [], [], [], [], [], [], []
            for doc_id, th, text in zip(b["doc_id"], b["th"], b["text"], strict=True):
                seen: dict[int, int | None] = {}  # the leaf's line in this text, none if there are several
                start = len(leaves)
                for at, line in enumerate(text.split("\n")):
                    tokens = masked(line)
                    if tokens and len(tokens) >= p.min_tokens:
                        leaf, key = keys(tokens, p.depth)
                        ids.append(None if pd.isna(doc_id) else int(doc_id))
                        hashes.append(th)
                        ats.append(at)
                        leaves.append(leaf)
                        lines.append(key)
                        needs.append(min(p.min_docs, p.long_docs) if len(tokens) >= p.long_tokens else p.min_docs)
                        if seen.setdefault(leaf, key) != key:
                            seen[leaf] = None
                twins += [seen[x] is None for x in leaves[start:]]
            yield pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "th": np.array(hashes, dtype=np.int64), "at": np.array(ats, dtype=np.int32), "leaf": np.array(leaves, dtype=np.int64), "line": np.array(lines, dtype=np.int64), "need": np.array(needs, dtype=np.int32), "twin": np.array(twins, dtype=bool)})

    base = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return base.mapInPandas(run, "doc_id long, th long, at int, leaf long, line long, need int, twin boolean")


def recurring(docs: DataFrame, p: TemplateParams = TemplateParams()) -> tuple[DataFrame, DataFrame]:
    """``(lines, templates)``: all candidate lines with their template, and the recurring templates.

    ``lines``: doc_id, th (text hash), at (line number), template; ``templates``: template, n_texts,
    first (doc_id and th of the text that keeps it).
    """
    lines = materialize(_lines(docs, p), "template-lines")
    once = lines.groupBy("leaf", "line", "need", "th").agg(F.min("doc_id").alias("doc_id"), F.min("at").alias("at"))
    order = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), "th")
    per_line = once.groupBy("leaf", "line", "need").agg(F.count("*").alias("n"), F.min(order).alias("first"), F.min_by("at", order).alias("at"))
    per_line = materialize(per_line, "template-counts")
    # Leaves that recur although one of their lines alone doesn't: only there can generalising change anything.
    leaves = per_line.groupBy("leaf", "need").agg(F.sum("n").alias("n"), F.min("n").alias("least"), F.count("*").alias("kinds"))
    open_leaves = leaves.where((F.col("n") >= F.col("need")) & (F.col("least") < F.col("need")) & (F.col("kinds") > 1)).select("leaf")
    unsure = materialize(per_line.join(open_leaves, "leaf"), "template-unsure")
    tokens = _tokens(docs, unsure, p)
    cells = tokens.select("leaf", "line", "n", "need", F.posexplode("tokens").alias("pos", "token"))
    # Texts are counted once a token: sums over lines count a text with several lines of the leaf more often, and what they
    # count too much is found from those texts' lines alone.
    twins = lines.where("twin").select("leaf", "line", "th").distinct().join(tokens.select("leaf", "line", "need", "tokens"), ["leaf", "line"])
    again = twins.select("leaf", "need", "th", F.posexplode("tokens").alias("pos", "token")).groupBy("leaf", "need", "pos", "token", "th").agg((1 - F.count("*")).alias("n"))
    counted = cells.select("leaf", "need", "pos", "token", "n").union(again.select("leaf", "need", "pos", "token", "n").where("n < 0"))
    common = counted.groupBy("leaf", "need", "pos", "token").agg(F.sum("n").alias("c")).where((F.col("c") >= F.col("need")) & (F.col("token") != WILD)).select("leaf", "pos", "token", F.lit(True).alias("kept"))
    marked = cells.join(common, ["leaf", "pos", "token"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    shape = marked.groupBy("leaf", "line").agg(F.count("*").alias("size"), F.count_if("kept").alias("fixed"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.when(F.col("kept"), F.col("token")).otherwise(WILD).alias("token")))), lambda x: x["token"]), " ").alias("template"))
    general = shape.where((F.col("fixed") >= p.similarity * F.col("size")) & (F.col("fixed") < F.col("size"))).select("leaf", "line", F.xxhash64("leaf", "template").alias("general"))
    # A line without any variable field belongs to the template of its leaf that equals it.
    general = materialize(general, "template-general")
    named = lines.join(_small(general, 64, p), ["leaf", "line"], "left")
    named = named.select("doc_id", "th", "at", "need", F.coalesce("general", F.xxhash64("leaf", "line")).alias("template"))
    named = materialize(named, "template-named")
    texts = named.groupBy("template", "need", "th").agg(F.min("doc_id").alias("doc_id"))
    found = texts.groupBy("template", "need").agg(F.count("*").alias("n_texts"), F.min(order).alias("first")).where(F.col("n_texts") >= F.col("need"))
    return named, materialize(found, "template-found")


def _tokens(docs: DataFrame, unsure: DataFrame, p: TemplateParams) -> DataFrame:
    """``leaf, line, n, need, tokens`` of the unsure lines, read again from one text that has them."""
    places = unsure.select(F.col("first.th").alias("th"), "at", "leaf", "line", "n", "need").groupBy("th").agg(F.collect_list(F.struct("at", "leaf", "line", "n", "need")).alias("wanted"))
    texts = docs.where("text is not null").select(F.xxhash64("text").alias("th"), "text")
    met = texts.join(_small(places, 64, p, "wanted", 48), "th")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, wanted in zip(b["text"], b["wanted"], strict=True):
                lines = text.split("\n")
                out += [(w["leaf"], w["line"], w["n"], w["need"], masked(lines[w["at"]])) for w in wanted]
            yield pd.DataFrame(out, columns=["leaf", "line", "n", "need", "tokens"])

    found = met.select("text", "wanted").mapInPandas(run, "leaf long, line long, n long, need int, tokens array<string>")
    return materialize(found.dropDuplicates(["leaf", "line"]), "template-tokens")


def dedup_lines(docs: DataFrame, p: TemplateParams = TemplateParams(), counts: bool = True) -> DataFrame:
    """``docs`` with recurring lines removed; n_chars is set anew if it is there.

    ``counts``: n_lines and n_dropped are added (in place of columns of these names).
    """
    own, th, at, kept, text, cut = fresh(docs, "own_th", "drop_th", "drop_at", "kept_at", "kept_text", "cut_text")
    lines, templates = recurring(docs, p)
    templates = templates.select("template", F.col("first.th").alias("keeper"))
    hits = lines.join(_small(templates, 48, p), "template").where("th <> keeper")
    drops = hits.select("th", "at").distinct().groupBy(F.col("th").alias(th)).agg(F.collect_list("at").alias(at))
    drops = _small(materialize(drops, "template-drops"), 64, p, at, 8)
    met = docs.withColumn(own, F.xxhash64("text")).join(drops, (F.col(own) == F.col(th)) & F.col("text").isNotNull(), "left")
    met = met.withColumn(cut, F.split("text", "\n", -1))
    parts = F.col(cut)  # a column of its own: inside the lambda below a text would be split once for each of its lines
    places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(at))  # by hash: linear in the lines
    met = met.withColumn(kept, F.when(F.col(at).isNotNull(), places))
    met = met.withColumn(text, F.when(F.col(at).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")))
    cleaned = {c: F.col(c) for c in docs.columns} | {"text": F.col(text)}
    if "n_chars" in docs.columns:
        cleaned["n_chars"] = F.coalesce(F.length(text).cast("long"), F.lit(0).cast("long"))
    if counts:
        cleaned["n_lines"] = F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("int")
        cleaned["n_dropped"] = F.coalesce(F.array_size(at), F.lit(0)).cast("int")
    return met.select(*[v.alias(c) for c, v in cleaned.items()])
