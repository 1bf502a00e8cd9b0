"""Chat formatting in budgeted windows, by DataFrame and SQL functions alone.

Turns of a conversation, in order, are laid out as training texts. Prefix sums of
turn tokens choose the windows, each aligned to whole turns. The system turn leaves
A = budget - its tokens; history gets h = min(``history``, A / 4) of that, new turns
the room R = A - h. A turn belongs to window floor(s / (R / 2)), s being the tokens before
it; the one turn that may reach beyond R from where its stride begins gets a window
of its own, and there no more history than fits beside it. So no window passes the budget
unless one turn and its system turn do by themselves (``over_budget``), and no turn
depends on how far others filled up. Every window begins with the conversation's system
turn, then repeats whole turns, at most h tokens, from before it, then has its new turns.
The loss mask covers the text of new assistant turns alone: what is repeated is never a
target twice. Tokens are an estimate (``tokens``), as no tokenizer runs natively.

A turn reads ``<|start|>role<|sep|>text<|end|>``. Where role or text holds a control
string, this template's or another's of ``CONTROLS``, a backslash goes in after its
first character, one more if backslashes are there already; so a control string never comes
from a text, and taking one backslash out restores it.

The prefix sums run over blocks of ``block`` turn numbers and then over the blocks'
totals. Windows are chosen from numbers alone, without texts; these are shuffled to
get their places, to meet their windows, and to be put together. One very long
conversation is spread over tasks until then.

Defined results: a null text is empty, a null role is the role ""; turns are ordered by turn (null
first), repeated turn numbers by role and text, and repeated rows all stay; a null conv_id is a
conversation; a system turn counts as such only as the first turn; an empty table gives
no windows; other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

START, SEP, STOP = "<|start|>", "<|sep|>", "<|end|>"
#: Strings that templates give a meaning to; all begin with < or [ and have no further one.
CONTROLS = r"\|start\|>|\|sep\|>|\|end\|>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]"


@dataclass(frozen=True)
class Options:
    budget: int = 1024
    history: int = 128
    overhead: int = 4  # tokens of a turn beside its text
    block: int = 256  # turn numbers in a block of the prefix sums


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({CONTROLS})", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({CONTROLS})", "$1$2$3")


def tokens(text: Column, overhead: int) -> Column:
    """An estimate, natively: runs of letters or digits of up to 6 characters, and single other marks."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]{1,6}|[^ \t\n\x0B\f\r\p{L}\p{N}]")) + overhead


def laid(conversations: DataFrame, o: Options = Options()) -> DataFrame:
    """The rows with role, text, tokens (n), block, and within it the place (at, from 0) and the tokens before (s); stored."""
    t = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("n", tokens(F.col("text"), o.overhead).cast("long")).withColumn("blk", F.floor(F.coalesce("turn", F.lit(-1)) / o.block))
    inner = Window.partitionBy("conv_id", "blk").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = inner.rowsBetween(Window.unboundedPreceding, -1)
    return stored(t.select("conv_id", "blk", (F.row_number().over(inner) - 1).cast("long").alias("at"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("s"), "n", "role", "text"), "laid")


def members(rows: DataFrame, o: Options = Options()) -> DataFrame:
    """From ``laid`` without its texts, which turn is in which window: conv_id, blk, at, k, alone, first_pos, pos, new."""
    t = rows.select("conv_id", "blk", "at", "s", "n", (F.col("role") == "system").alias("system"))
    first = F.max(F.when((F.col("at") == 0) & F.col("system"), F.col("n"))).alias("y")
    blocks = t.groupBy("conv_id", "blk").agg(F.sum("n").alias("bn"), F.count("*").alias("bc"), first)
    conv = Window.partitionBy("conv_id")
    before = conv.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "blk", "y", F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("bs"), F.coalesce(F.sum("bc").over(before), F.lit(0)).alias("bp"), F.sum("bc").over(conv).alias("total"))
    blocks = blocks.withColumn("y", F.max(F.when(F.col("bp") == 0, F.col("y"))).over(conv))
    blocks = blocks.select(F.col("conv_id").alias("bconv"), F.col("blk").alias("bblk"), "bs", "bp", "total", F.col("y").isNotNull().alias("has_y"), F.coalesce("y", F.lit(0)).alias("y"))
    t = t.join(blocks, F.col("conv_id").eqNullSafe(F.col("bconv")) & (F.col("blk") == F.col("bblk"))).drop("bconv", "bblk", "system")
    left = F.lit(o.budget) - F.col("y")
    t = t.withColumns({"pos": F.col("at") + F.col("bp"), "from": F.col("s") + F.col("bs") - F.col("y"), "h": F.least(F.lit(o.history).cast("long"), F.greatest(F.floor(left / 4), F.lit(0)))})
    t = t.withColumn("room", F.greatest(left - F.col("h"), F.lit(2).cast("long"))).withColumn("stride", F.floor(F.col("room") / 2))
    t = t.withColumn("y_row", F.col("has_y") & (F.col("pos") == 0)).withColumn("k", F.when(F.col("y_row"), 0).otherwise(F.floor(F.col("from") / F.col("stride"))))
    t = t.withColumn("alone", F.when(~F.col("y_row") & (F.col("from") + F.col("n") - F.col("k") * F.col("stride") > F.col("room")), 1).otherwise(0))
    t = t.withColumn("bucket", F.floor(F.col("from") / max(o.history, 1)))
    body = stored(t.select("conv_id", "blk", "at", "pos", "from", "n", "k", "alone", "y_row", "has_y", "y", "h", "total", "bucket"), "turns")
    # a conversation of the system turn alone still has a window
    heads = body.where(~F.col("y_row") | (F.col("total") == 1)).groupBy("conv_id", "k", "alone").agg(F.min("from").alias("w_from"), F.min("pos").alias("first_pos"), F.sum(F.when(F.col("y_row"), 0).otherwise(F.col("n"))).alias("w_n"), *(F.first(c).alias(c) for c in ("has_y", "y", "h")))
    # the system turn is new in the conversation's first window, repeated in the others
    heads = heads.withColumn("first_pos", F.when(F.col("has_y") & (F.col("first_pos") == 1), 0).otherwise(F.col("first_pos"))).withColumn("most", F.least("h", F.lit(o.budget) - F.col("y") - F.col("w_n")))
    heads = stored(heads, "windows")
    named = heads.select(F.col("conv_id").alias("wconv"), F.col("k").alias("wk"), F.col("alone").alias("walone"), "w_from", "first_pos", "most")
    same = F.col("conv_id").eqNullSafe(F.col("wconv"))
    turn = body.where(~F.col("y_row"))
    own = turn.join(named, same & (F.col("k") == F.col("wk")) & (F.col("alone") == F.col("walone"))).withColumn("new", F.lit(True))
    # history begins within one bucket's tokens before its window
    back = turn.join(named.where("most > 0").withColumn("in", F.explode(F.array(F.floor(F.col("w_from") / max(o.history, 1)), F.floor(F.col("w_from") / max(o.history, 1)) - 1))), same & (F.col("bucket") == F.col("in")))
    back = back.where((F.col("from") < F.col("w_from")) & (F.col("w_from") - F.col("from") <= F.col("most"))).withColumn("new", F.lit(False))
    cols = ["conv_id", "blk", "at", F.col("wk").alias("k"), F.col("walone").alias("alone"), "first_pos", "pos", "new"]
    system = body.where("y_row").select(F.col("conv_id").alias("yconv"), "blk", "at")
    system = heads.where("has_y").join(system, F.col("conv_id").eqNullSafe(F.col("yconv"))).select("conv_id", "blk", "at", "k", "alone", "first_pos", F.lit(0).cast("long").alias("pos"), (F.col("first_pos") == 0).alias("new"))
    return own.select(*cols).unionByName(back.select(*cols)).unionByName(system)


def windows(conversations: DataFrame, o: Options = Options()) -> DataFrame:
    """A row per window: conv_id, window (pair: stride number, 1 for a turn that stands alone), first_pos,
    formatted, loss_spans (code points, from and to, of escaped texts), new_turns (a flag per turn), n_tokens, over_budget."""
    rows = laid(conversations, o)
    m = members(rows, o).select(*(F.col(c).alias("m_" + c) for c in ("conv_id", "blk", "at")), "k", "alone", "first_pos", "pos", "new")
    t = rows.join(m, F.col("conv_id").eqNullSafe(F.col("m_conv_id")) & (F.col("blk") == F.col("m_blk")) & (F.col("at") == F.col("m_at")))
    item = F.struct("pos", "new", "role", "n", escaped(F.col("role")).alias("erole"), escaped(F.col("text")).alias("etext"))
    w = t.groupBy("conv_id", "k", "alone", "first_pos").agg(F.array_sort(F.collect_list(item)).alias("items"))
    size = f"char_length(x.erole) + char_length(x.etext) + {len(START + SEP + STOP)}"
    return w.selectExpr(
        "conv_id", "struct(k stride, alone) window", "first_pos",
        f"array_join(transform(items, x -> concat('{START}', x.erole, '{SEP}', x.etext, '{STOP}')), '') formatted",
        # a fold keeps the place reached and the spans so far
        f"""aggregate(items, named_struct('at', 0L, 'spans', cast(array() as array<struct<start:bigint,end:bigint>>)), (a, x) -> named_struct('at', a.at + {size},
            'spans', if(x.new and x.role = 'assistant', array_append(a.spans, named_struct('start', a.at + char_length(x.erole) + {len(START + SEP)}, 'end', a.at + {size} - {len(STOP)})), a.spans)), a -> a.spans) loss_spans""",
        "transform(items, x -> x.new) new_turns", "aggregate(items, 0L, (a, x) -> a + x.n) n_tokens", f"aggregate(items, 0L, (a, x) -> a + x.n) > {o.budget} over_budget",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """From the windows alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    parts = F.filter(F.split("formatted", F.lit(r"\Q" + STOP + r"\E"), -1), lambda x: x != "")
    w = formatted.select("conv_id", "first_pos", F.length("formatted").cast("long").alias("chars"), parts.alias("parts"), "new_turns", "formatted", "loss_spans")
    fresh = F.filter(F.arrays_zip(F.col("parts").alias("part"), F.col("new_turns").alias("new")), lambda x: x["new"])
    body = F.transform(fresh, lambda x: F.substring(x["part"], F.lit(len(START) + 1), F.length(x["part"])))
    role = lambda x: unescaped(F.split_part(x, F.lit(SEP), F.lit(1)))
    text = lambda x: unescaped(F.split_part(x, F.lit(SEP), F.lit(2)))
    w = w.select(
        "conv_id", "chars", "first_pos",
        F.size(fresh).cast("long").alias("n"),
        F.array_join(F.transform(body, lambda x: F.concat(role(x), F.lit("\n"), text(x), F.lit("\n"))), "").alias("turns"),
        F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "").alias("loss"),
    )
    each = w.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("first_pos", "turns", "loss"))).alias("w"))
    turns_text, loss = (F.expr(f"array_join(transform(w, x -> x.{c}), '')") for c in ("turns", "loss"))
    return each.select("conv_id", "n_turns", F.sha2(turns_text.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The table and conversation -7, whose two turns say what looks like control strings."""
    spark = conversations.sparkSession
    probe = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)


_DEFAULT = Options()
ORACLE_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') role, coalesce(text, '') text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (SELECT *, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]{{1,6}}|[^ \t\n\x0B\f\r\p{{L}}\p{{N}}]')) + {_DEFAULT.overhead} n,
  length(regexp_replace(role, '([<\[])(\\*)({CONTROLS})', '\1\\\2\3', 'g')) + length(regexp_replace(text, '([<\[])(\\*)({CONTROLS})', '\1\\\2\3', 'g')) + {len(START + SEP + STOP)} sz,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 pos FROM c),
u AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY pos) - n s, max(CASE WHEN pos = 0 AND role = 'system' THEN n END) OVER (PARTITION BY conv_id) yn, max(CASE WHEN pos = 0 AND role = 'system' THEN sz END) OVER (PARTITION BY conv_id) ysz FROM t),
h AS (SELECT *, s - coalesce(yn, 0) f, least({_DEFAULT.history}, greatest(({_DEFAULT.budget} - coalesce(yn, 0)) // 4, 0)) h FROM u),
r AS (SELECT *, greatest({_DEFAULT.budget} - coalesce(yn, 0) - h, 2) room FROM h),
k AS (SELECT *, f // (room // 2) k, CASE WHEN f + n - (f // (room // 2)) * (room // 2) > room THEN 1 ELSE 0 END alone FROM r WHERE NOT (pos = 0 AND yn IS NOT NULL)),
w AS (SELECT conv_id, k wk, alone wa, min(f) wf, max(ysz) ysz, least(max(h), {_DEFAULT.budget} - coalesce(max(yn), 0) - sum(n)) most FROM k GROUP BY ALL),
lens AS (SELECT w.conv_id, wk, wa, sum(sz) + coalesce(max(w.ysz), 0) z FROM w JOIN k ON k.conv_id = w.conv_id AND ((k = wk AND alone = wa) OR (f < wf AND wf - f <= most)) GROUP BY ALL),
fc AS (SELECT conv_id, sum(z) z FROM lens GROUP BY conv_id)
SELECT conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) loss_sha256, CAST(coalesce(max(fc.z), max(sz)) AS BIGINT) formatted_chars
FROM t LEFT JOIN fc USING (conv_id) GROUP BY conv_id
"""
