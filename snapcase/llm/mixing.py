"""Mixing of sources to target weights by Pfair scheduling, with DataFrame functions only.

Documents of a source are numbered and cut into blocks.  With weight w (a source's share
of the slots) block j of a source is released at floor((j-1)/w) and due at ceil(j/w).
One block runs per slot: of the blocks released, the one due first, which keeps every
prefix within less than one block of each source's share.  Weights are whole numbers a
out of A = sum(a), so releases and deadlines are exact: the sizes themselves by default,
other weights rounded as finely as 64-bit products with the number of blocks allow.

The schedule is cut into periods of slots, which are scheduled in parallel, as rows that
list their blocks.  What a period needs is the numbers of blocks done before it, one for each
source.  They are guessed from the shares (the whole blocks due by then, and of the blocks
begun those due first); every period is run from its guess, and one that does not start where
the period before ended is run again from there, until all fit: from period 0 on, which starts
with none, each start is then the exact one.  Two passes are the rule, whatever the size, and
no task holds more than a few periods.

A block is ``block_docs`` documents.  The registered query and the pipeline's stage pass
``BLOCK_DOCS``, so a document's block and rank do not depend on the size of the corpus.  Only
a caller that names no size gets blocks that grow beyond about a million documents, so that
there are at most ``MOST_SLOTS`` slots.

The mix ends where the first source would run out, at T = min(blocks / w) slots; a
source's first ceil(w * T) blocks are in the mix, and later ones are marked as outside it
and have no slot.  The blocks that are left at T, at most one for each source, follow it.
The default target is each source's size, so every document is in the mix.  Documents are
left out only where a caller passes weights, or ``hot_share`` to count a source as at most
that many times the mean size.

Numbering never brings a source together: its rows are dealt to about sqrt(n) cells by
the hash of their id, numbered within a cell, and offset by the sizes of earlier cells.

Rows: a null source is a source of its own; rows that repeat an id are numbered one by
one; a source with weight 0, null or none is outside the mix; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import run_folder, stored

# Documents of a block, and the slots at most where a caller leaves the size of a block open.
BLOCK_DOCS = 8
MOST_SLOTS = 131_072
# Slots of a period.
PERIOD = 1024


def block_size(rows: int) -> int:
    """Documents of a block for a corpus of that many, where the caller names none."""
    return max(BLOCK_DOCS, -(-rows // MOST_SLOTS))


def target_weights(sizes: DataFrame, hot_share: float | None = None) -> DataFrame:
    """Target (source, weight): the size, or up to ``hot_share`` times the mean size."""
    if hot_share is None:
        return sizes.select("source", F.col("n").cast("double").alias("weight"))
    mean = F.avg("n").over(Window.partitionBy())
    return sizes.select("source", F.least(F.col("n").cast("double"), hot_share * mean).alias("weight"))


# State: for each source its next block's deadline, place in the table of sources, release
# and number of blocks before it.  A source whose blocks are all done is never released.
_NEXT = """named_struct('due', ({done} + 1) * total div {s}.share
                           + if(({done} + 1) * total % {s}.share = 0, 0L, 1L),
                        'at', {at},
                        'release', if({done} < {s}.quota, {done} * total div {s}.share,
                                      9223372036854775807L),
                        'done', {done}, 'share', {s}.share, 'quota', {s}.quota)"""
_PICK = "array_min(filter({now}, c -> c.release <= slot))"
_STEP = ("transform({now}, c -> if(c.at = pick.at, "
         + _NEXT.format(done="(c.done + 1)", s="c", at="c.at") + ", c))")


def _state(done: str) -> str:
    return f"transform(sources, (s, i) -> {_NEXT.format(done=done, s='s', at='i')})"


def _spread(starts: DataFrame, table: DataFrame, period: int) -> DataFrame:
    """``starts`` with the table of sources, over as many tasks as there are cores to use."""
    periods = table.agg(F.max(F.ceil(F.col("slots") / period))).first()[0] or 1
    cores = starts.sparkSession.sparkContext.defaultParallelism
    # A given number: the rows are few and small, and all their work is in the folds.
    return starts.repartition(min(periods, 2 * cores), "p").crossJoin(table)


def _period_starts(table: DataFrame, period: int, folder: str) -> DataFrame:
    """(p, start): numbers of blocks done before each period, by place in the table of sources."""
    first = f"(bigint(p) * {period})"
    step = f"transform(array({_PICK.format(now='now')}), pick -> {_STEP.format(now='now')})[0]"
    end = f"""transform(aggregate(sequence({first}, least({first} + {period}, slots) - 1),
                        {_state('start[i]')}, (now, slot) -> {step}), c -> c.done)"""

    def run(starts: DataFrame, name: str) -> DataFrame:
        return stored(_spread(starts, table, period).select("p", "start", F.expr(end).alias("end")),
                      f"{folder}/{name}")

    whole = _state(f"least(s.quota, {first} * s.share div total)")
    begun = (table.select("*", F.expr(f"explode(sequence(0L, (slots - 1) div {period}))").alias("p"))
             .withColumn("now", F.expr(whole))
             .withColumn("more", F.expr(f"int({first} - aggregate(now, 0L, (n, c) -> n + c.done))"))
             .withColumn("ahead", F.expr(f"transform(slice(array_sort(filter(now, c -> c.release < {first})),"
                                         " 1, greatest(more, 0)), c -> c.at)")))
    ran = run(begun.select("p", F.expr(
        "transform(now, c -> c.done + if(array_contains(ahead, c.at), 1L, 0L))").alias("start")), "pass-0")
    passes = 0
    while True:
        passes += 1
        before = ran.select((F.col("p") + 1).alias("p"), F.col("end").alias("given"))
        fitted = ran.join(before, "p", "left")
        moved = stored(fitted.filter("start <> given").select("p", F.col("given").alias("start")),
                       f"{folder}/moved-{passes}")
        if moved.isEmpty():
            return ran.select("p", "start")
        again = run(moved, f"again-{passes}")
        ran = stored(ran.join(moved.select("p"), "p", "left_anti").unionByName(again),
                     f"{folder}/pass-{passes}")


def block_slots(quotas: DataFrame, period: int, folder: str) -> DataFrame:
    """(source, block, slot) of the blocks in the mix.

    ``quotas`` has one row per source (source, share, quota); sources are few.
    """
    table = stored(quotas.agg(F.sort_array(F.collect_list(F.struct(
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("name"),
        "source", "share", "quota"))).alias("sources"), F.sum("share").alias("total"),
        F.sum("quota").alias("slots")).filter("slots > 0"), f"{folder}/sources")
    starts = _period_starts(table, period, folder)
    first = f"(bigint(p) * {period})"
    order = f"""
        aggregate(
          sequence({first}, least({first} + {period}, slots) - 1),
          named_struct('now', {_state('start[i]')},
                       'order', cast(array() as array<struct<at:int,block:bigint>>)),
          (state, slot) -> transform(array({_PICK.format(now='state.now')}), pick -> named_struct(
            'now', {_STEP.format(now='state.now')},
            'order', concat(state.order, array(named_struct('at', pick.at, 'block', pick.done + 1)))))[0],
          state -> state.order)"""
    return (_spread(starts, table, period)
            .select("p", "sources", F.posexplode(F.expr(order)).alias("place", "e"))
            .select(F.get("sources", F.col("e.at")).getField("source").alias("source"),
                    F.col("e.block").alias("block"),
                    (F.col("p").cast("long") * period + F.col("place")).alias("slot")))


def _whole(weight: Column, blocks: Column) -> Column:
    """Weights as whole numbers of which the sum times the blocks fits 64 bits."""
    everything = Window.partitionBy()
    room = F.lit(2.0 ** 62) / (F.sum(blocks).over(everything) + 2)
    total = F.sum(weight).over(everything)
    exact = F.min(weight == F.floor(weight)).over(everything) & (total <= room)
    scale = F.when(exact, 1.0).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(room / total)) - 1))
    return F.greatest(F.lit(1), F.round(weight * scale).cast("long"))


def numbered(docs: DataFrame, key: str, source: str, sizes: DataFrame, folder: str,
             name: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with column ``name``: a number from 1 within each source.

    ``sizes`` (source, n) is a table read from files, so Spark broadcasts it only when
    its size allows.
    """
    cells = sizes.select(F.col("source").alias(f"{name}_source"),
                         F.ceil(F.sqrt("n")).alias(f"{name}_cells"))
    dealt = (docs.join(cells, F.col(source).eqNullSafe(F.col(f"{name}_source")))
             .withColumn(f"{name}_hash", F.xxhash64(key))
             .withColumn(f"{name}_cell", F.pmod(f"{name}_hash", f"{name}_cells"))
             .drop(f"{name}_source", f"{name}_cells"))
    counts = dealt.groupBy(source, f"{name}_cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(source).orderBy(f"{name}_cell")
    offsets = stored(counts.select(
        F.col(source).alias(f"{name}_source"), F.col(f"{name}_cell").alias(f"{name}_at"),
        (F.sum("n").over(before) - F.col("n")).alias(f"{name}_offset")), f"{folder}/offsets")
    within = Window.partitionBy(source, f"{name}_cell").orderBy(
        f"{name}_hash", key, *(F.xxhash64(c) for c in ties))
    return (dealt.withColumn(name, F.row_number().over(within))
            .join(offsets, F.col(source).eqNullSafe(F.col(f"{name}_source"))
                  & (F.col(f"{name}_cell") == F.col(f"{name}_at")))
            .withColumn(name, F.col(name) + F.col(f"{name}_offset"))
            .drop(f"{name}_hash", f"{name}_cell", f"{name}_source", f"{name}_at", f"{name}_offset"))


def scheduled(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
              weights: DataFrame | None = None, block_docs: int | None = None,
              period: int = PERIOD, hot_share: float | None = None, tag: str = "mix",
              ties: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with a struct column ``tag``: block, release, deadline, slot, rank, in_mix."""
    folder = run_folder(docs.sparkSession, "mixing")
    sizes = stored(docs.groupBy(F.col(source_col).alias("source")).agg(
        F.count(F.lit(1)).alias("n")), f"{folder}/sizes")
    block_docs = block_docs or block_size(sizes.agg(F.sum("n")).first()[0] or 0)
    whole = weights is None and hot_share is None
    weights = target_weights(sizes, hot_share) if weights is None else weights
    weights = stored(weights.filter("weight > 0").groupBy("source").agg(
        F.sum("weight").alias("weight")), f"{folder}/weights")
    used = sizes.alias("s").join(weights.alias("w"), F.expr("s.source <=> w.source")).select(
        "s.source", "n", "weight")
    everything = Window.partitionBy()
    shares = (used.withColumn("weight", F.col("weight").cast("double"))
              .withColumn("blocks", F.ceil(F.col("n") / block_docs))
              .withColumn("share", _whole(F.col("weight"), F.col("blocks")))
              .withColumn("total", F.sum("share").over(everything))
              .withColumn("end", F.min(F.struct((F.col("blocks") / F.col("share")).alias("at"),
                                                "blocks", "share")).over(everything)))
    quota = F.col("blocks") if whole else F.expr(
        "least(blocks, (share * end.blocks + end.share - 1) div end.share)")
    quotas = stored(shares.select("source", "share", "total", quota.alias("quota")),
                    f"{folder}/quotas")
    slots = stored(block_slots(quotas, period, folder), f"{folder}/slots")
    plan = quotas.select(F.col("source").alias(f"{tag}_source"),
                         F.struct("quota", "share", "total").alias(f"{tag}_plan"))
    rows = numbered(docs, id_col, source_col, sizes, folder, f"{tag}_no", ties)
    rows = (rows.join(plan, F.col(source_col).eqNullSafe(F.col(f"{tag}_source")), "left")
            .withColumn(f"{tag}_block", F.expr(f"({tag}_no - 1) div {block_docs} + 1")))
    at = slots.select(F.col("source").alias(f"{tag}_of"), F.col("block").alias(f"{tag}_at"),
                      F.col("slot").alias(f"{tag}_slot"))
    rows = rows.join(at, F.col(source_col).eqNullSafe(F.col(f"{tag}_of"))
                     & (F.col(f"{tag}_block") == F.col(f"{tag}_at")), "left")
    p, block = f"{tag}_plan", f"{tag}_block"
    return (rows.withColumn(tag, F.struct(
        F.col(block).alias("block"),
        F.expr(f"({block} - 1) * {p}.total div {p}.share").alias("release"),
        F.expr(f"({block} * {p}.total + {p}.share - 1) div {p}.share").alias("deadline"),
        F.col(f"{tag}_slot").alias("slot"),
        F.expr(f"({tag}_no - 1) % {block_docs}").alias("rank"),
        F.expr(f"coalesce({block} <= {p}.quota, false)").alias("in_mix")))
        .drop(f"{tag}_no", block, f"{tag}_source", p, f"{tag}_of", f"{tag}_at", f"{tag}_slot"))


def mix_schedule(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
                 **options) -> DataFrame:
    """One row per document: doc_id, source, block, release, deadline, slot, rank, in_mix."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(source_col).alias("source"))
    return scheduled(rows, **options).select("doc_id", "source", "mix.*")


def mixed(docs: DataFrame, source_col: str = "source", text_col: str = "text",
          **options) -> DataFrame:
    """The rows of ``docs`` in the mix, in its order, with the columns of ``docs``."""
    tag = "mix"
    while any(c.lower().startswith(tag) for c in docs.columns):
        tag += "_"
    rows = scheduled(docs, source_col=source_col, tag=tag, ties=(text_col,), **options)
    return (rows.filter(F.col(f"{tag}.in_mix")).orderBy(f"{tag}.slot", f"{tag}.rank")
            .select(*docs.columns))
