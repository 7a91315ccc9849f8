"""Chat formatting for training, with DataFrame functions only.

Method: budgeted windows.  Prefix sums of turn tokens choose spans of whole
turns; each window keeps the system turn, repeats limited history before its
new turns, and only new assistant turns are targets, so that each is one once.
A conversation of over CHUNK turns is taken in chunks, each with the history
before it and the turns after it that a window may reach, so that no task holds
more than a chunk of it.  Where a chunk's first window starts depends on the
chunks before; each chunk tells it for every start, and these maps are composed
level by level.  So the windows are the same for every size of chunk.

Template: `<turn>role`, a line break, the text, `</turn>`, a line break.  In
texts and roles a backslash is written `\\b` and `<` is written `\\l`, in roles
also a line break `\\e`; so no text can hold a marker, and reading back gives
the text as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.columns import numbered
from .common import let, written

OPEN, CLOSE = "<turn>", "</turn>\n"
#: Turns of a conversation that are new in one array at most, and chunks whose maps are composed together.
CHUNK, FAN = 4096, 64


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\e"), F.lit("\n")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def tokens(text: Column) -> Column:
    """Estimate: a token is four bytes; a turn's marks are four tokens."""
    return F.ceil(F.octet_length(text) / 4) + 4


def _chunks(turns: DataFrame, history_turns: int, chunk: int, ahead: int) -> DataFrame:
    """One row a chunk of a conversation: conv_id, chunk, t (its turns in order), first (place in t of the first that is new), n_new.

    Before the new turns come the system turn and the history of the chunks
    before, after them `ahead` turns of the next ones.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["turn", "role", "text"]
    if rows.groupBy("conv_id").count().where(F.col("count") > chunk).isEmpty():
        rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("conv_id").orderBy(*order)) - 1)
    else:
        rows = numbered(rows, *order, within=["conv_id"], name="nth")
    rows = rows.withColumns({"nth": F.col("nth").cast("long"), "chunk": F.expr(f"nth div {chunk}"), "kind": F.lit(1)})
    # the chunks that a turn is history of, and those that look ahead at it
    copies = lambda low, high, kind: rows.withColumns({"_low": F.expr(low), "_high": F.expr(high)}).where("_low <= _high").withColumns({"chunk": F.explode(F.sequence("_low", "_high")), "kind": F.lit(kind)}).drop("_low", "_high")
    old = copies(f"nth div {chunk} + 1", f"(nth + {history_turns}) div {chunk}", 0)
    later = copies(f"greatest(0, (nth - {ahead} + {chunk}) div {chunk} - 1)", f"nth div {chunk} - 1", 2)
    heads = rows.where((F.col("nth") > 0) & (F.col("nth") % chunk == 0)).select(F.col("conv_id").alias("_c"), F.col("chunk").alias("_k"))
    system = rows.where("nth = 0 and role = 'system'").drop("chunk").join(heads, F.col("conv_id").eqNullSafe(F.col("_c"))).where(F.col("_k") * chunk - history_turns > 0)
    system = system.withColumns({"chunk": F.col("_k"), "kind": F.lit(0)}).select(*rows.columns)
    rows = rows.unionByName(old).unionByName(later).unionByName(system)
    upto = W.partitionBy("conv_id", "chunk").orderBy("nth").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("sum", F.sum(tokens(F.col("text"))).over(upto))
    start = F.concat(F.lit(OPEN), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\e")), F.lit("\n"))
    item = F.struct("nth", "role", "text", "sum", start.alias("head"), escaped(F.col("text")).alias("body"))
    of_kind = lambda k: F.count_if(F.col("kind") == k).cast("int")
    return rows.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list(item)).alias("t"), of_kind(0).alias("first"), of_kind(1).alias("n_new")).where("n_new > 0")


def _entries(chunks: DataFrame, step: str, ahead: int, chunk: int) -> DataFrame:
    """conv_id, chunk and entry: how far behind a chunk's first new turn its first window starts.

    step: the place in t at which the window after one from place i starts, null at the end.  Each chunk
    maps every entry to that of the next chunk; up to FAN maps make one of the level above, and the entries
    come down the levels again.
    """
    behind = f"coalesce({step}, size(t))"  # all that is left of the conversation is in the window
    # from the last new turn to the first, the place behind the chunk that windows from each lead to
    leads = f"""aggregate(sequence(n_new - 1, 0, -1), cast(array() as array<int>), (a, k) -> transform(array(first + k), i -> concat(array(
        transform(array({behind}), j -> if(j >= first + n_new, j - first - n_new, a[j - i - 1]))[0]), a))[0])"""
    whole = f"transform(array({leads}), a -> transform(sequence(0, {ahead}), e -> if(e < n_new, get(a, e), e - {chunk})))[0]"
    levels = [written(chunks.select("conv_id", "chunk", F.expr(whole).alias("m")))]
    high = lambda c: F.expr(f"{c} div {FAN}")
    while levels[-1].where("chunk > 0").limit(1).count():
        group = levels[-1].groupBy("conv_id", high("chunk").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("chunk", "m"))).alias("c"))
        # composed maps keep entries in bounds: what a chunk is never entered at may lead anywhere
        levels.append(written(group.select("conv_id", "chunk", F.expr(f"aggregate(c, sequence(0, {ahead}), (a, x) -> transform(a, e -> x.m[e]))").alias("m"))))
    entries = levels.pop().select("conv_id", "chunk", F.lit(0).alias("entry"))
    while levels:
        below = levels.pop().groupBy("conv_id", high("chunk").alias("_k")).agg(F.sort_array(F.collect_list(F.struct("chunk", "m"))).alias("c"))
        met = below.join(entries.withColumnsRenamed({"conv_id": "_c", "chunk": "_e"}), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_k") == F.col("_e")))
        each = "aggregate(c, named_struct('e', entry, 'out', cast(array() as array<struct<chunk:bigint,entry:int>>)), (a, x) -> named_struct('e', x.m[a.e], 'out', concat(a.out, array(named_struct('chunk', x.chunk, 'entry', a.e))))).out"
        entries = met.select("conv_id", F.inline(F.expr(each)))
    return entries


def windows(turns: DataFrame, budget: int = 1024, history: int = 256, history_turns: int = 8, chunk: int = CHUNK) -> DataFrame:
    """One row a window: conv_id, window, text, context_turns, loss, n_tokens.

    turns: conv_id, turn, role, text.  Rows are ordered by turn, then role and
    text; nulls come first, and a null role or text is empty; repeated rows are
    turns each.  context_turns: turns at the window's head that are repeated, the
    system turn and then at most history tokens and history_turns turns before
    the new ones.  loss: (start, length) of targets in code points.  A window
    holds budget tokens at most, unless its one new turn is larger, which is kept
    whole.  A conversation's role "system" counts as its system turn if first.
    A window's number is that of its first new turn.  chunk changes no window.
    """
    ahead = budget // 4 + 2  # a turn has four tokens at least, so no window has more new ones
    convs = _chunks(turns, history_turns, chunk, ahead)
    # tokens before turn i, and of turn i
    before = "if(i = 0, 0L, t[greatest(i - 1, 0)].sum)"
    system = "if(t[0].nth = 0 and t[0].role = 'system', 1, 0)"
    back = f"filter(sequence(greatest(least({system}, i), i - {history_turns}), i), j -> {before} - if(j = 0, 0L, t[greatest(j - 1, 0)].sum) <= {history})[0]"
    context = f"if(i = 0, 0L, {system} * t[0].sum + {before} - if({back} = 0, 0L, t[greatest({back} - 1, 0)].sum))"
    # a window from place i ends before the first turn that is too much for it
    step = f"get(transform(array(least({budget}L, {context}) - {before}), used -> filter(sequence(least(i + 1, size(t) - 1), least(i + {ahead}, size(t) - 1)), j -> j > i and used + t[j].sum > {budget}))[0], 0)"
    if convs.where("chunk > 0").limit(1).count():
        convs = written(convs)
        entries = _entries(convs, step, ahead, chunk).withColumnsRenamed({"conv_id": "_c", "chunk": "_k"})
        convs = convs.join(entries, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("chunk") == F.col("_k"))).where("entry < n_new").drop("_c", "_k")
    else:
        convs = convs.withColumn("entry", F.lit(0))
    context_first = f"transform(array(first + entry), i -> {context})[0]"
    starts = f"""aggregate(sequence(first + entry, size(t) - 1), named_struct('at', array(first + entry), 'used', least({budget}L, {context_first})), (a, i) -> if(
        a.used + t[i].sum - {before} > {budget} and i > element_at(a.at, -1),
        named_struct('at', concat(a.at, array(i)), 'used', least({budget}L, {context}) + t[i].sum - {before}),
        named_struct('at', a.at, 'used', a.used + t[i].sum - {before}))).at"""
    # history is dropped where it would not fit beside the first new turn
    tight = f"{context} + t[i].sum - {before} > {budget}"
    repeated = f"if(i = 0, slice(t, 1, 0), concat(slice(t, 1, {system}), if({tight}, slice(t, 1, 0), slice(t, {back} + 1, i - {back}))))"
    # windows that start behind the chunk are the next one's
    cut = f"filter(transform(at, (i, k) -> if(i < first + n_new, named_struct('window', t[i].nth, 'old', {repeated}, 'new', slice(t, i + 1, if(k + 1 < size(at), element_at(at, least(k + 2, size(at))), size(t)) - i)), null)), w -> w is not null)"
    out = convs.withColumn("at", F.expr(starts)).select("conv_id", F.explode(F.expr(cut)).alias("w"))
    out = out.select("conv_id", "w.window", F.size("w.old").alias("context_turns"), F.concat("w.old", "w.new").alias("all"))
    size = lambda x: F.length(x["head"]) + F.length(x["body"]) + len(CLOSE)
    # places where turns begin
    begin = F.aggregate("all", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + size(x))))
    spans = let(begin, lambda b: F.filter(F.transform("all", lambda x, k: F.struct((b[k] + F.length(x["head"])).alias("start"), F.length(x["body"]).alias("length"), ((x["role"] == "assistant") & (k >= F.col("context_turns"))).alias("target"))), lambda s: s["target"]))
    text = F.array_join(F.transform("all", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "")
    n = F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + tokens(x["text"]))
    return out.select("conv_id", "window", text.alias("text"), "context_turns", F.transform(spans, lambda s: F.struct(s["start"], s["length"])).alias("loss"), n.alias("n_tokens"))


def read_back(rows: DataFrame) -> DataFrame:
    """One row a window of windows(): conv_id, window, turns (role, text) that are new in it, loss_text, chars."""
    pieces = lambda p: F.transform(F.slice(p, F.col("context_turns") + 1, F.greatest(F.size(p) - 1 - F.col("context_turns"), F.lit(0))), turn)

    def turn(piece: Column) -> Column:
        inner = F.substring(piece, F.lit(len(OPEN) + 1), F.length(piece))
        role = F.substring_index(inner, "\n", 1)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substring(inner, F.length(role) + 2, F.length(inner))).alias("text"))

    loss = F.array_join(F.transform("loss", lambda s: unescaped(F.substring(F.col("text"), s["start"] + 1, s["length"]))), "")
    return rows.select("conv_id", "window", let(F.split(F.col("text"), CLOSE), pieces).alias("turns"), loss.alias("loss_text"), F.length("text").alias("chars"))


def digests(rows: DataFrame) -> DataFrame:
    """One row a conversation, from read_back(): counts and SHA-256 of its turns and of its targets."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = rows.select("conv_id", "window", F.size("turns").alias("n"), said.alias("said"), "loss_text", "chars")
    convs = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "n", "said", "loss_text", "chars"))).alias("w"))
    total = lambda field: F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x[field])
    joined = lambda field: F.array_join(F.transform("w", lambda x: x[field]), "")
    convs = convs.select("conv_id", total("n").alias("n_turns"), joined("said").alias("said"), joined("loss_text").alias("loss_text"), total("chars").alias("formatted_chars"))
    return convs.select("conv_id", "n_turns", F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
