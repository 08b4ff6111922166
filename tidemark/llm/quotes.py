"""Chat formatting by quotation linking, in DataFrame functions only.

Lines of a message are parsed into quote levels; each run of lines of one level above zero is a quoted passage. Passages
are normalised, hashed, and joined within their conversation to the first message that has the same text as its own: whole,
as a paragraph, or as a line. The lowest linked level tells which message is answered; links make threads, in which a
message follows what it answers; quotes are taken out of the text.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import common

MARKS = r"^(?:[ \t]*>)+"
KEY = ["conv_id", "turn"]


def quoting(text: str = "text") -> Column:
    """Whether the message has a quoted line at all: only such messages need their lines looked at."""
    return F.coalesce(F.col(text).rlike(r"(^|\n)[ \t]*>"), F.lit(False))


def _normal(body: Column) -> Column:
    """Lower case, runs of blanks as one space, no blanks at the ends."""
    return F.trim(F.lower(F.regexp_replace(body, r"[ \t\r\f]+", " ")))


def _line(line: Column) -> Column:
    level = F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), r"[ \t]", ""))
    body = F.regexp_replace(line, MARKS + r" ?", "")
    norm = _normal(body)
    return F.struct(F.when((level == 0) & (norm == ""), -1).otherwise(level).alias("level"), norm.alias("norm"))


def parsed(messages: DataFrame, text: str = "text") -> DataFrame:
    """messages with _tm_runs: (level, lines) of each run of lines of one level; level -1: blank lines of the message's own."""
    rows = messages.withColumn("_tm_lines", F.transform(F.split(common.whole(text), "\n"), _line))
    starts = F.expr("filter(sequence(0, size(_tm_lines) - 1), i -> i = 0 or get(_tm_lines, i).level != get(_tm_lines, i - 1).level)")
    rows = rows.withColumn("_tm_starts", starts)
    runs = F.expr(
        "transform(_tm_starts, (s, k) -> named_struct('level', get(_tm_lines, s).level, 'lines', filter(transform("
        "slice(_tm_lines, s + 1, coalesce(get(_tm_starts, k + 1), size(_tm_lines)) - s), x -> x.norm), x -> x != '')))"
    )
    return rows.withColumn("_tm_runs", runs).drop("_tm_lines", "_tm_starts")


def own_text(text: str = "text") -> Column:
    """The message without its quoted lines, trimmed; null stays null."""
    kept = F.filter(F.split(F.col(text), "\n"), lambda line: ~line.rlike(r"^[ \t]*>"))
    own = F.when(quoting(text), F.array_join(kept, "\n")).otherwise(F.col(text))
    return F.regexp_replace(own, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def reply_links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to): of the quoted passages that an earlier message has as its own text, those of the lowest
    level decide, whole passages before single lines, then the latest such message. Rows of equal (conv_id, turn) count
    as one message. First occurrences are minima that are combined before the shuffle, so a text that many messages share
    makes one row per conversation, and the join is a plain one that the engine may split at a hot passage."""
    rows = messages.select(*KEY, "text")
    sha = lambda c: F.sha2(c, 256)
    own = F.filter("_tm_runs", lambda r: r["level"] == 0)
    whole = F.concat_ws(" ", F.flatten(F.transform(own, lambda r: r["lines"])))
    units = F.array_distinct(F.flatten(F.array(F.array(whole), F.transform(own, lambda r: F.concat_ws(" ", r["lines"])), F.flatten(F.transform(own, lambda r: r["lines"])))))
    quoted = F.filter("_tm_runs", lambda r: (r["level"] > 0) & (F.size(r["lines"]) > 0))
    quotes = parsed(rows.filter(quoting())).select(*KEY, F.explode(quoted).alias("q"))
    tried = F.concat(F.array(F.struct(F.lit(2).alias("part"), F.concat_ws(" ", "q.lines").alias("t"))), F.transform("q.lines", lambda x: F.struct(F.lit(1).alias("part"), x.alias("t"))))
    quotes = quotes.select(*KEY, F.col("q.level").alias("level"), F.explode(tried).alias("x")).select(*KEY, "level", "x.part", sha("x.t").alias("hash"))
    quotes = common.cut(quotes.distinct(), "quotes")
    asked = quotes.select("conv_id").distinct()
    firsts = parsed(rows.join(asked, "conv_id", "left_semi")).select(*KEY, F.explode(units).alias("t")).filter("t != ''")
    firsts = common.cut(firsts.groupBy("conv_id", sha("t").alias("hash")).agg(F.min("turn").alias("first")), "originals")
    found = quotes.join(firsts, ["conv_id", "hash"]).filter("first < turn")
    best = F.max(F.struct((-F.col("level")).alias("level"), "part", "first"))
    return found.groupBy(*KEY).agg(best.alias("best")).select(*KEY, F.col("best.first").alias("reply_to"))


def threads(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(conv_id, turn, reply_to, thread, depth) of each message that answers one: its thread's first turn and its distance
    from it. Pointers double each round, so a chain of n messages takes log2 n rounds; each is written to the shared folder."""
    state = common.cut(links.select(*KEY, "reply_to", F.col("reply_to").alias("thread"), F.lit(1).alias("depth")), "threads")
    for _ in range(most_rounds):
        up = state.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("_up"), F.col("depth").alias("_more"))
        state = common.cut(state.join(up, ["conv_id", "thread"], "left").select(*KEY, "reply_to", F.coalesce("_up", "thread").alias("thread"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"), F.col("_up").isNotNull().alias("_moved")), "threads")
        if state.filter("_moved").isEmpty():
            return state.drop("_moved")
    raise RuntimeError("threads: rounds are used up")


def linked(messages: DataFrame) -> DataFrame:
    """Conversations in reply order, without quotes, from messages (conv_id, turn, role, text).

    Adds to each message: clean (its own text), n_quotes (quoted passages), reply_to (the turn it answers, null for none),
    thread (first turn of its thread), depth, and chat (clean between marks of its role). Ordered by (conv_id, thread,
    turn), a message follows what it answers. A null text has a null clean and an empty chat body; a message whose quotes
    nobody wrote, or without quotes, begins a thread; a null conv_id or turn begins one too. Repeated rows stay; an empty
    table gives no rows; other columns pass through, but one named as an output is replaced. One row per message is given,
    as a conversation may be longer than a row should be.
    """
    out = ["clean", "n_quotes", "reply_to", "thread", "depth", "chat"]
    links = threads(reply_links(messages))
    rows = parsed(messages.drop(*out).withColumn("_tm_quoting", F.when(quoting(), F.col("text"))), "_tm_quoting")
    rows = rows.withColumn("n_quotes", F.size(F.filter("_tm_runs", lambda r: (r["level"] > 0) & (F.size(r["lines"]) > 0)))).drop("_tm_runs", "_tm_quoting")
    rows = rows.join(links, KEY, "left").withColumn("clean", own_text())
    rows = rows.withColumn("thread", F.coalesce("thread", "turn")).withColumn("depth", F.coalesce("depth", F.lit(0)))
    return rows.withColumn("chat", F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("clean", F.lit("")), F.lit("\n<|end|>")))


COLUMNS = ["conv_id", "turn", "role", "n_quotes", "reply_to", "thread", "depth", "clean", "chat"]


def query(spark, sf_dir: str) -> DataFrame:
    """The whole table of conversations as it is."""
    return linked(common.table(spark, sf_dir, "conversations")).select(*COLUMNS)


def with_quotes(messages: DataFrame) -> DataFrame:
    """The messages as mail: each is preceded by what it answers, and that by what it answered, in nested quotes."""
    first = messages.groupBy(*KEY).agg(F.min(F.struct("role", "text")).alias("m")).select(*KEY, "m.role", "m.text")
    before = lambda k: first.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("text").alias(f"_{k}"))
    rows = first.join(before(1), KEY, "left").join(before(2), KEY, "left")
    mark = lambda c, m: F.concat(F.lit(m), F.regexp_replace(c, "\n", "\n" + m), F.lit("\n"))
    return rows.select(*KEY, "role", F.concat(F.coalesce(mark(F.col("_2"), "> > "), F.lit("")), F.coalesce(mark(F.col("_1"), "> "), F.lit("")), "text").alias("text"))


def mail_query(spark, sf_dir: str) -> DataFrame:
    """The same over the table's messages with quotes put in, as mail programs do."""
    return linked(with_quotes(common.table(spark, sf_dir, "conversations"))).select(*COLUMNS)


_SQL = r"""
rows as (select row_number() over () as rid, * from {source}),
split as (select rid, conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from rows),
marked as (select *, length(regexp_replace(regexp_extract(line, '^([ \t]*>)+'), '[ \t]', '', 'g')) as raw,
  trim(lower(regexp_replace(regexp_replace(line, '^([ \t]*>)+ ?', ''), '[ \t\r\f]+', ' ', 'g'))) as norm from split),
leveled as (select *, case when raw = 0 and norm = '' then -1 else raw end as level from marked),
stepped as (select *, case when level = lag(level) over (partition by rid order by i) then 0 else 1 end as step from leveled),
numbered as (select *, sum(step) over (partition by rid order by i) as run from stepped),
runs as (select rid, conv_id, turn, run, min(level) as level, string_agg(norm, ' ' order by i) as t from numbered where norm <> '' group by all),
units as (select conv_id, turn, string_agg(norm, ' ' order by i) as t from numbered where level = 0 group by rid, conv_id, turn
  union select conv_id, turn, t from runs where level = 0
  union select conv_id, turn, norm from numbered where level = 0 and norm <> ''),
firsts as (select conv_id, t, min(turn) as first from units group by all),
tried as (select conv_id, turn, level, 2 as part, t from runs where level > 0
  union select conv_id, turn, level, 1, norm from numbered where level > 0 and norm <> ''),
found as (select q.conv_id, q.turn, q.level, q.part, f.first from tried q join firsts f on q.conv_id = f.conv_id and q.t = f.t and f.first < q.turn),
links as (select conv_id, turn, first as reply_to from (select *, row_number() over (partition by conv_id, turn order by level, part desc, first desc) as k from found) where k = 1),
climb as (select conv_id, turn, reply_to as thread, 1 as depth from links
  union all select c.conv_id, c.turn, l.reply_to, c.depth + 1 from climb c join links l on l.conv_id = c.conv_id and l.turn = c.thread),
tops as (select conv_id, turn, max_by(thread, depth) as thread, max(depth) as depth from climb group by all),
counted as (select rid, count(*) as n from runs where level > 0 group by rid),
cleaned as (select rows.*, regexp_replace(list_aggregate(list_filter(string_split(text, chr(10)), lambda x: not regexp_matches(x, '^[ \t]*>')), 'string_agg', chr(10)), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') as own from rows)
select r.conv_id, r.turn, r.role, cast(coalesce(c.n, 0) as integer) as n_quotes, l.reply_to, coalesce(t.thread, r.turn) as thread, cast(coalesce(t.depth, 0) as integer) as depth,
  case when r.text is null then null else coalesce(r.own, '') end as clean,
  '<|' || coalesce(r.role, '') || '|>' || chr(10) || coalesce(r.own, '') || chr(10) || '<|end|>' as chat
from cleaned r left join counted c on r.rid = c.rid left join links l on r.conv_id = l.conv_id and r.turn = l.turn left join tops t on r.conv_id = t.conv_id and r.turn = t.turn
"""
SQL = "with recursive" + _SQL.format(source="conversations")
MAIL_SQL = "with recursive first as (select conv_id, turn, min(row(role, text)) as m from conversations group by all), mail as (select a.conv_id, a.turn, a.m[1] as role, coalesce('> > ' || replace(c.m[2], chr(10), chr(10) || '> > ') || chr(10), '') || coalesce('> ' || replace(b.m[2], chr(10), chr(10) || '> ') || chr(10), '') || a.m[2] as text from first a left join first b on a.conv_id = b.conv_id and a.turn = b.turn + 1 left join first c on a.conv_id = c.conv_id and a.turn = c.turn + 2)," + _SQL.format(source="mail")
