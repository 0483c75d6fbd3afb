"""Chunkers: structure packing, fixed windows, heading split."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragspark import fixed
from ragspark.functions.packing import count_words, pack_blocks, split_block
from ragspark.functions.text import strip, token_count
from ragspark.operators.ranking import row_numbers
from ragspark.session import materialise, spread

CHUNKS = "array<struct<text:string,labels:array<string>>>"


def packed(
    units: Column, header: Column, *, max_tokens: int = fixed.MAX_TOKENS, max_chars: int = fixed.MAX_CHARS,
    count: Callable[[str], int] = count_words,
) -> Column:
    """Chunks of a parent whose units sit in one row (``array<struct<label,text>>``).

    A document is one row, so packing it needs no shuffle.
    """
    @F.pandas_udf(CHUNKS)
    def run(rows: pd.Series, headers: pd.Series) -> pd.Series:
        return pd.Series([
            [{"text": t, "labels": ls} for t, ls in pack_blocks(
                [(u["label"], u["text"]) for u in (units if units is not None else [])], h or "", max_tokens, max_chars, count)]
            for units, h in zip(rows, headers)
        ])

    return run(units, header)


def line_units(text: Column) -> Column:
    """The lines of a text as units, labelled by line number."""
    return F.transform(
        F.split(text, "\n"), lambda line, i: F.struct(i.cast("string").alias("label"), line.alias("text"))
    )


def chunk_documents(docs: DataFrame, key: str, units: Column, header: Column, **limits) -> DataFrame:
    """``key, chunk_index, chunk_id, text, labels`` for parents held in one row each."""
    found = spread(docs).select(key, packed(units, header, **limits).alias("_c"))
    # A plain explode makes the optimiser test the array first and so pack every document twice.
    return found.select(key, F.posexplode_outer("_c").alias("chunk_index", "c")).where(F.col("c").isNotNull()).select(
        key, "chunk_index", chunk_name(F.col(key), F.col("chunk_index")).alias("chunk_id"), "c.text", "c.labels"
    )


def chunk_name(parent: Column, index: Column) -> Column:
    return F.format_string("%s-%03d", parent.cast("string"), index)


def fixed_windows(
    docs: DataFrame, key: str, text: str, *, size: int = fixed.FIXED_WINDOW_TOKENS,
    overlap: float = fixed.FIXED_WINDOW_OVERLAP,
) -> DataFrame:
    """Overlapping word windows: ``key, chunk_index, chunk_id, text, n_words``. No shuffle."""
    shared = int(size * overlap)
    words = F.filter(F.split(F.col(text), r"(?U)\s+"), lambda w: w != "")
    last = F.greatest(F.size("_w") - shared - 1, F.lit(0))
    starts = F.when(F.size("_w") > 0, F.sequence(F.lit(0), last, F.lit(size - shared)))
    # Windows are cut before the explode, so that no row carries its whole document.
    cut = F.transform(starts, lambda s: F.struct(
        F.array_join(F.slice("_w", s + 1, size), " ").alias("text"), F.least(F.lit(size), F.size("_w") - s).alias("n_words")
    ))
    windows = docs.select(key, words.alias("_w")).select(
        key, F.posexplode_outer(cut).alias("chunk_index", "c")
    ).where(F.col("c").isNotNull())
    return windows.select(
        key, "chunk_index", chunk_name(F.col(key), F.col("chunk_index")).alias("chunk_id"), "c.text", "c.n_words"
    )


def fixed_windows_of_parts(
    parts: DataFrame, key: str, *, size: int = fixed.FIXED_WINDOW_TOKENS, overlap: float = fixed.FIXED_WINDOW_OVERLAP,
) -> DataFrame:
    """The windows of documents that come in consecutive parts ``key, part, text``.

    Equal to :func:`fixed_windows` over the joined parts, without joining them:
    word counts place each part in its document, and a window that starts near
    the end of a part takes its last words from the head of the next one. Every
    part but the last must hold at least ``size`` words.
    """
    shared = int(size * overlap)
    step = size - shared
    words = parts.select(key, "part", F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "").alias("_w"))
    words = materialise(words.withColumn("_n", F.size("_w").cast("long")))
    counts = words.select(key, "part", "_n")
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.select(
        key, "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at"),
        F.sum("_n").over(Window.partitionBy(key)).alias("_total"),
    )
    heads = words.select(key, (F.col("part") - 1).alias("part"), F.slice("_w", 1, size).alias("_next"))
    joined = words.join(placed, [key, "part"]).join(heads, [key, "part"], "left")
    first = F.ceil(F.col("_at") / step)
    last = F.floor(F.least(F.col("_at") + F.col("_n") - 1, F.greatest(F.col("_total") - shared - 1, F.lit(0))) / step)
    short = F.raise_error(F.lit(f"a part before the last one has fewer than {size} words")).cast("array<bigint>")
    starts = F.when(F.col("_next").isNotNull() & (F.col("_n") < size), short).when(last >= first, F.sequence(first, last))
    text = F.concat("_w", F.coalesce("_next", F.array().cast("array<string>")))
    def windows_of(all_words):
        return F.transform(starts, lambda m: F.struct(
            m.cast("int").alias("chunk_index"),
            F.array_join(F.slice(all_words, (m * step - F.col("_at")).cast("int") + 1, size), " ").alias("text"),
            F.least(F.lit(size), F.col("_total") - m * step).cast("int").alias("n_words"),
        ))

    # The one-element array binds the joined words once for all windows of a part.
    cut = F.flatten(F.transform(F.array(text), windows_of))
    windows = joined.select(key, F.explode_outer(cut).alias("c")).where(F.col("c").isNotNull())
    return windows.select(
        key, "c.chunk_index", chunk_name(F.col(key), F.col("c.chunk_index")).alias("chunk_id"), "c.text", "c.n_words"
    )


def policy_title(content: Column) -> Column:
    """First level-1 heading line, with a default."""
    line = strip(F.regexp_extract(content, r"(?m)^(# .*)$", 1))
    return F.coalesce(F.nullif(line, F.lit("")), F.lit("# Policy"))


def policy_units(content: Column) -> Column:
    """Level-2 sections of a policy as units.

    Text before the first heading is labelled ``preamble``; level-1 lines belong
    to no unit; sections without a body are dropped.
    """
    def unit(part):
        heading = strip(F.regexp_extract(part, r"^(## [^\n]*)", 1))
        lines = F.filter(F.split(F.regexp_replace(part, r"^## [^\n]*", ""), "\n"), lambda l: ~l.startswith("# "))
        body = strip(F.array_join(lines, "\n"))
        return F.struct(
            F.coalesce(F.nullif(heading, F.lit("")), F.lit("preamble")).alias("label"),
            F.when(heading != "", F.concat(heading, F.lit("\n\n"), body)).otherwise(body).alias("text"),
            body.alias("body"),
        )
    parts = F.transform(F.split(content, r"(?m)^(?=## )"), unit)
    return F.transform(
        F.filter(parts, lambda u: u["body"] != ""),
        lambda u: F.struct(u["label"].alias("label"), u["text"].alias("text")),
    )


def pack_units(
    units: DataFrame, *, max_tokens: int = fixed.MAX_TOKENS, max_chars: int = fixed.MAX_CHARS,
    count: Callable[[str], int] = count_words, block_units: int = 1024,
) -> DataFrame:
    """Structure packing of ``units(parent, ord, label, text, header)``, one unit per row.

    Returns ``parent, chunk_index, text, labels``; (parent, ord) is unique and
    ``count`` must be additive over texts joined by a blank line;
    :func:`packers.pack_in_blocks` takes any counter.

    Packing is greedy, so where a chunk starts depends on all units before it.
    To keep a parent of any size out of a single task, its units are cut into
    blocks, and only their sizes take part: a chunk has at most
    ``(max_chars + 2) / 3`` units, so a block needs just a short look-ahead. Each
    block reports, for every unit at which a chunk could enter it, where the
    chain enters the next block; these small maps are composed by pointer
    jumping, and each block then assigns its units from its real entry. A parent
    of one block, the usual case, skips the composition. Texts join once, at the
    end, in groups no larger than a chunk.
    """
    ahead = (max_chars + 2) // 3 + 1
    block_units = max(block_units, ahead)
    sized = materialise(_sizes(units, max_tokens, max_chars, count))
    numbers = ["n_tok", "n_chr", "t_room", "c_room"]
    placed = materialise(
        row_numbers(sized.select("parent", "ord", *numbers), ["parent"], F.floor(F.col("ord") / 4096), [F.col("ord")], "pos")
        .withColumn("pos", F.col("pos") - 1).withColumn("block", F.floor(F.col("pos") / block_units))
    )
    inside = F.col("pos") - F.col("block") * block_units
    homes = F.when(
        (F.col("block") > 0) & (inside < ahead), F.array(F.col("block"), F.col("block") - 1)
    ).otherwise(F.array(F.col("block")))
    shared = placed.withColumn("home", F.explode(homes)).drop("block")
    blocks = placed.groupBy("parent").agg(F.max("block").alias("last"))
    long_parents = blocks.where(F.col("last") > 0)

    def next_starts(pdf: pd.DataFrame) -> np.ndarray:
        """Start of the chunk after the one that starts at each unit."""
        n_tok, n_chr = pdf["n_tok"].to_numpy(), pdf["n_chr"].to_numpy()
        tokens, chars = int(pdf["t_room"].iloc[0]), int(pdf["c_room"].iloc[0])
        at = np.arange(len(pdf))
        alone = (n_tok > tokens) | (n_chr > chars)
        t_sum = np.concatenate([[0], np.cumsum(n_tok)])
        c_sum = np.concatenate([[0], np.cumsum(n_chr + 2)])
        by_tok = np.searchsorted(t_sum, t_sum[:-1] + tokens, side="right") - 1
        by_chr = np.searchsorted(c_sum, c_sum[:-1] + chars + 2, side="right") - 1
        stops = np.minimum.accumulate(np.where(alone, at, len(pdf))[::-1])[::-1]
        return np.where(alone, at + 1, np.minimum(np.minimum(by_tok, by_chr), stops))

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        nxt = next_starts(pdf.sort_values("pos"))
        out = nxt.copy()
        for i in range(min(block_units, len(nxt)) - 1, -1, -1):
            if nxt[i] < min(block_units, len(nxt)):
                out[i] = out[nxt[i]]
        home = int(pdf["home"].iloc[0])
        jump = np.maximum(out[:ahead] - block_units, 0).astype("int32").tolist()
        return pd.DataFrame({"parent": [pdf["parent"].iloc[0]], "block": [home + 1], "src": [home], "jump": [jump]})

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        nxt, at = next_starts(pdf), int(pdf["entry"].iloc[0])
        first = at
        k = []
        while at < min(block_units, len(pdf)):
            k += [len(k) and k[-1] + 1] * (int(nxt[at]) - at)
            at = int(nxt[at])
        return pdf.iloc[first:first + len(k)][["parent", "ord", "home"]].assign(k=np.array(k, dtype="int32"))

    parent = f"parent {placed.schema['parent'].dataType.simpleString()}"
    entries = blocks.select("parent", F.lit(0).cast("long").alias("home"), F.lit(0).alias("entry"))
    if long_parents.limit(1).count():
        of_long = shared.join(long_parents, "parent").where(F.col("home") < F.col("last"))
        links = of_long.groupBy("parent", "home").applyInPandas(exits, f"{parent}, block bigint, src bigint, jump array<int>")
        entries = entries.unionByName(_resolve(materialise(links)).withColumnRenamed("block", "home"))
    assigned = shared.join(entries, ["parent", "home"]).groupBy("parent", "home").applyInPandas(
        assign, f"{parent}, ord bigint, home bigint, k int"
    )

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series, t_room: pd.Series, c_room: pd.Series) -> pd.Series:
        return pd.Series([
            None if t is None else split_block(t, int(tr), int(cr), count) for t, tr, cr in zip(texts, t_room, c_room)
        ])

    grouped = sized.join(assigned, ["parent", "ord"]).groupBy("parent", "home", "k").agg(
        F.array_sort(F.collect_list(F.struct("ord", "label", "text"))).alias("u"), F.first("prefix").alias("prefix"),
        F.first("t_room").alias("t_room"), F.first("c_room").alias("c_room"),
        F.max((F.col("n_tok") > F.col("t_room")) | (F.col("n_chr") > F.col("c_room"))).alias("over"),
    ).withColumn("body", F.array_join(F.transform("u", lambda u: u["text"]), "\n\n"))
    pieces = F.coalesce(split(F.when(F.col("over"), F.col("body")), F.col("t_room"), F.col("c_room")), F.array("body"))
    chunks = materialise(grouped.select(
        "parent", "home", "k", F.transform(pieces, lambda p: F.concat(F.col("prefix"), p)).alias("texts"),
        F.array_distinct(F.transform("u", lambda u: u["label"])).alias("labels"),
    ).withColumn("n", F.size("texts")))
    return _numbered(chunks).select(
        "parent", F.posexplode("texts").alias("_p", "text"), "labels", "base"
    ).select(
        "parent", (F.col("base") + F.col("_p")).cast("int").alias("chunk_index"), "text", "labels"
    )


def _sizes(units: DataFrame, max_tokens: int, max_chars: int, count: Callable[[str], int]) -> DataFrame:
    """Non-blank units with their sizes and the room their header leaves."""
    if count is count_words:
        tokens = token_count
    else:
        @F.pandas_udf("int")
        def tokens(texts: pd.Series) -> pd.Series:
            return texts.map(count)

    header = strip(F.coalesce("header", F.lit("")))
    prefix = F.when(header != "", F.concat(header, F.lit("\n\n"))).otherwise("")
    trimmed = spread(units).select(
        "parent", F.col("ord").cast("long").alias("ord"), "label", strip(F.coalesce("text", F.lit(""))).alias("text"), prefix.alias("prefix")
    ).where(F.col("text") != "")
    t_room = F.lit(max_tokens) - tokens(F.col("prefix"))
    c_room = F.lit(max_chars) - F.length("prefix")
    roomless = F.raise_error(F.lit(f"a header leaves no room under {max_tokens} tokens and {max_chars} characters")).cast("int")
    return trimmed.select(
        "*", tokens(F.col("text")).alias("n_tok"), F.length("text").alias("n_chr"),
        F.when((t_room > 0) & (c_room > 0), t_room).otherwise(roomless).alias("t_room"), c_room.alias("c_room"),
    )


def _numbered(chunks: DataFrame) -> DataFrame:
    """Add ``base``, the number of pieces before each chunk of a parent, from piece counts alone."""
    before = (Window.unboundedPreceding, -1)
    narrow = chunks.select("parent", "home", "k", "n")
    totals = narrow.groupBy("parent", "home").agg(F.sum("n").alias("n"))
    of_home = totals.select(
        "parent", "home", F.coalesce(F.sum("n").over(Window.partitionBy("parent").orderBy("home").rowsBetween(*before)), F.lit(0)).alias("_h")
    )
    in_home = narrow.select(
        "parent", "home", "k",
        F.coalesce(F.sum("n").over(Window.partitionBy("parent", "home").orderBy("k").rowsBetween(*before)), F.lit(0)).alias("_k"),
    )
    base = in_home.join(of_home, ["parent", "home"]).select("parent", "home", "k", (F.col("_h") + F.col("_k")).alias("base"))
    return chunks.join(base, ["parent", "home", "k"])


def _resolve(links: DataFrame) -> DataFrame:
    """Entry of every later block by pointer jumping over ``links(parent, block, src, jump)``.

    ``jump`` maps an entry of block ``src`` to the entry of ``block``. Each round
    halves the distance to block 0, whose entry is 0.
    """
    while links.where(F.col("src") > 0).limit(1).count():
        before = links.select(
            "parent", F.col("block").alias("src"), F.col("src").alias("_src"), F.col("jump").alias("_jump")
        )
        jumped = links.where(F.col("src") > 0).join(before, ["parent", "src"]).select(
            "parent", "block", F.col("_src").alias("src"),
            F.transform("_jump", lambda e: F.element_at(F.col("jump"), e + 1)).alias("jump"),
        )
        links = materialise(links.where(F.col("src") == 0).unionByName(jumped))
    return links.select("parent", "block", F.element_at("jump", 1).alias("entry"))
