"""Quotation linking: conversations in reply order, without the quotes.

A line's quote level is the number of > before it. Neighbouring lines of one level make a
passage. Passages and their single lines are normalised (lower case, white space as single
spaces) and hashed; what a message says itself (level 0) is hashed in the same way, as a
whole, by passage and by line.

Messages are ordered by (conv_id, turn), and an origin must come before the message that
quotes it. It is the first message of the same conversation that says the passage, or else, for
whole passages of at least OUTSIDE words, the first of all messages that does; a single line or a
short passage ("> Yes") says too little to point into another conversation. A message replies to the origin of its lowest-level
linked quote (whole passages before lines), or without one to the turn of its conversation
before it. So replies only point back: there are no cycles, and every reply points to a
message that exists.

Conversations: each message gets its body without the quotes, its position (the turns of its
conversation before it), and the root and depth of its thread, which follows replies into
other conversations. Ordered by conv_id and position, every message comes after what it
replies to.

Only DataFrame functions are used. Texts are parsed once, and what was parsed is stored.
Only hashes that some quote has are looked for, reduced to one row each before the joins, so
a passage that a third of all messages quote is looked up, never paired; AQE splits such keys.
Positions are counted in ranges of RANGE turns and then over ranges, so a conversation with
very many turns doesn't meet in one task. Roots are found by pointer jumping: the rounds
are the logarithm of the longest thread, and a message that has reached its root rests.

Null and empty texts have an empty body and no quotes; very long texts are rows like others.
Rows with equal conv_id and turn are one message for links: its quotes and what it says
are those of all its rows, each of which is returned. Rows without conv_id or turn are
returned without links. Other columns stay; those named like a result are replaced.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import WORD, aside, restored, stored, table

MARKS = r"^(?:[\x20\x09]*>)+"
WROTE = r"^[\x20\x09]*(On|Am|Le|El) [^\n]{1,200}(wrote|schrieb|écrit|escribió)[^\n]{0,80}:[\x20\x09]*$"
#: Control characters that part passages and their levels; they don't stay in the text.
PASSAGE, LEVEL = "\x1e", "\x1f"
RANGE = 64
#: Words from which a whole passage may link to another conversation.
OUTSIDE = 5
RESULTS = ("body", "n_quotes", "n_linked", "max_level", "reply_conv", "reply_turn", "root_conv", "root_turn", "depth", "position")


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def digest(text: Column) -> Column:
    return F.unhex(F.md5(normalised(text).cast("binary")))


def parsed_lines(text: Column) -> Column:
    """array<struct<level, body>> of a text's lines; the line that introduces a quote is level -1."""
    plain = F.translate(F.coalesce(text, F.lit("")), PASSAGE + LEVEL + "\r", "")
    lines = F.transform(F.split(plain, "\n"), lambda x: F.struct(F.regexp_count(F.regexp_extract(x, MARKS, 0), F.lit(">")).alias("level"), F.regexp_replace(x, MARKS + r"[\x20\x09]?", "").alias("body")))
    def introduces(ls: Column):
        return lambda x, i: F.struct(F.when((x["level"] == 0) & (F.get(ls, i + 1)["level"] > 0) & x["body"].rlike(WROTE), F.lit(-1)).otherwise(x["level"]).alias("level"), x["body"].alias("body"))
    return F.transform(F.array(lines), lambda ls: F.transform(ls, introduces(ls)))[0]


def passages(lines: Column) -> Column:
    """array<struct<level, text>>: runs of lines of one level, in order."""
    def marked(ls: Column) -> Column:
        cut = F.transform(ls, lambda x, i: F.when((i == 0) | (F.get(ls, i - 1)["level"] != x["level"]), F.concat(F.lit(PASSAGE), x["level"].cast("string"), F.lit(LEVEL), x["body"])).otherwise(F.concat(F.lit("\n"), x["body"])))
        return F.filter(F.split(F.array_join(cut, ""), PASSAGE), lambda p: p != "")
    runs = F.transform(F.array(lines), marked)[0]
    return F.transform(runs, lambda p: F.struct(F.substring_index(p, LEVEL, 1).cast("int").alias("level"), F.substring_index(p, LEVEL, -1).alias("text")))


def keys(runs: Column, body: Column, outside: int) -> Column:
    """array<struct<level, rank, far, hash>> of passages (rank 0), of their lines (rank 1), and of the body.

    far: whether it may link to other conversations.
    """
    def key(level: Column, rank: int, far: Column, text: Column) -> Column:
        return F.struct(level.alias("level"), F.lit(rank).alias("rank"), far.alias("far"), digest(text).alias("hash"))

    usable = F.filter(runs, lambda p: (p["level"] >= 0) & p["text"].rlike(WORD))
    whole = F.transform(usable, lambda p: key(p["level"], 0, F.regexp_count(p["text"], F.lit(WORD)) >= outside, p["text"]))
    lines = F.flatten(F.transform(usable, lambda p: F.transform(F.filter(F.split(p["text"], "\n"), lambda x: x.rlike(WORD)), lambda x: key(p["level"], 1, F.lit(False), x))))
    return F.array_distinct(F.concat(whole, lines, F.array(key(F.lit(0), 0, F.lit(False), body))))


def parsed(messages: DataFrame, outside: int) -> DataFrame:
    """The messages' columns set aside, with _conv, _turn, body, n_quotes, max_level and _keys."""
    rows = messages.select(*aside(messages), F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), parsed_lines(F.col("text")).alias("_lines"))
    said = F.array_join(F.transform(F.filter("_lines", lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    rows = rows.withColumns({"_runs": passages(F.col("_lines")), "body": F.regexp_replace(said, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")})
    return rows.withColumns({
        "n_quotes": F.size(F.filter("_runs", lambda p: p["level"] > 0)).cast("bigint"),
        "max_level": F.greatest(F.array_max(F.transform("_lines", lambda x: x["level"])), F.lit(0)),
        "_keys": keys(F.col("_runs"), F.col("body"), outside),
    }).drop("_lines", "_runs")


def turns(known: DataFrame) -> DataFrame:
    """(_conv, _turn, _before, position) of every message: the turn before it, and how many there are before it."""
    each = known.select("_conv", "_turn").distinct().withColumn("_range", F.floor(F.col("_turn") / RANGE))
    inside, over = Window.partitionBy("_conv", "_range").orderBy("_turn"), Window.partitionBy("_conv").orderBy("_range")
    ranges = each.groupBy("_conv", "_range").agg(F.count(F.lit(1)).alias("_n"), F.max("_turn").alias("_max"))
    ahead = ranges.select("_conv", "_range", F.lag("_max").over(over).alias("_last"), (F.sum("_n").over(over) - F.col("_n")).alias("_ahead"))
    placed = each.withColumns({"_own": F.lag("_turn").over(inside), "_place": F.row_number().over(inside) - 1}).join(ahead, ["_conv", "_range"])
    return placed.select("_conv", "_turn", F.coalesce("_own", "_last").alias("_before"), (F.col("_ahead") + F.col("_place")).cast("bigint").alias("position"))


def quote_links(known: DataFrame) -> DataFrame:
    """(_conv, _turn, _best, n_linked) of messages with a quote that an earlier message says."""
    each = known.select("_conv", "_turn", F.explode("_keys").alias("_k")).select("_conv", "_turn", "_k.*")
    quoted = known.where("n_quotes > 0").select("_conv", "_turn", F.explode("_keys").alias("_k")).select("_conv", "_turn", "_k.*").where("level > 0").distinct()
    own = each.where("level = 0").join(quoted.select("hash").distinct(), "hash", "left_semi")
    here = own.groupBy("_conv", "hash").agg(F.min("_turn").alias("_said"))
    first = here.groupBy("hash").agg(F.min(F.struct(F.col("_conv").alias("conv"), F.col("_said").alias("turn"))).alias("_first"))
    found = quoted.join(here, ["_conv", "hash"], "left").join(first, "hash", "left")
    inside = F.when(F.col("_said") < F.col("_turn"), F.struct(F.col("_conv").alias("conv"), F.col("_said").alias("turn")))
    elsewhere = F.when(F.col("far") & (F.col("_first.conv") < F.col("_conv")), F.col("_first"))
    links = found.withColumn("_to", F.coalesce(inside, elsewhere)).where(F.col("_to").isNotNull())
    return links.groupBy("_conv", "_turn").agg(F.min(F.struct("level", "rank", "_to")).alias("_best"), F.sum((F.col("rank") == 0).cast("bigint")).alias("n_linked"))


def threads(replies: DataFrame) -> DataFrame:
    """(_conv, _turn, root_conv, root_turn, depth) of messages (_conv, _turn, _up_conv, _up_turn), by pointer jumping."""
    no_reply = F.col("_up_conv").isNull()
    at = replies.select("_conv", "_turn", F.coalesce("_up_conv", "_conv").alias("root_conv"), F.coalesce("_up_turn", "_turn").alias("root_turn"), F.when(no_reply, 0).otherwise(1).cast("bigint").alias("depth"), (~no_reply).alias("open"))
    at = stored(at, "threads")
    ended = at.where("not open").drop("open")
    while not at.where("open").isEmpty():
        left = at.where("open").drop("open")
        up = ended.unionByName(left).where("depth > 0").select(F.col("_conv").alias("root_conv"), F.col("_turn").alias("root_turn"), F.col("root_conv").alias("_c"), F.col("root_turn").alias("_t"), F.col("depth").alias("_d"))
        further = left.join(up, ["root_conv", "root_turn"], "left")
        at = stored(further.select("_conv", "_turn", F.coalesce("_c", "root_conv").alias("root_conv"), F.coalesce("_t", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"), F.col("_c").isNotNull().alias("open")), "threads")
        ended = ended.unionByName(at.where("not open").drop("open"))
    return ended


def linked(messages: DataFrame, outside: int = OUTSIDE) -> DataFrame:
    """messages (conv_id, turn, text and more) with RESULTS; outside: words from which a passage may link to another conversation."""
    messages = messages.drop(*RESULTS)
    rows = stored(parsed(messages, outside), "parsed")
    known = rows.where(F.col("_conv").isNotNull() & F.col("_turn").isNotNull())
    best = turns(known).join(quote_links(known), ["_conv", "_turn"], "left")
    to = F.coalesce(F.col("_best._to"), F.when(F.col("_before").isNotNull(), F.struct(F.col("_conv").alias("conv"), F.col("_before").alias("turn"))))
    replies = stored(best.select("_conv", "_turn", "position", "n_linked", to["conv"].alias("_up_conv"), to["turn"].alias("_up_turn")), "replies")
    placed = replies.join(threads(replies), ["_conv", "_turn"])
    out = rows.join(placed, ["_conv", "_turn"], "left")
    return out.select(
        *restored(messages), "body", "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "max_level",
        F.col("_up_conv").alias("reply_conv"), F.col("_up_turn").alias("reply_turn"), "root_conv", "root_turn", "depth", "position",
    )


def conversations(messages: DataFrame) -> DataFrame:
    """The linked messages in reply order of each conversation."""
    return linked(messages).orderBy("conv_id", "position")


def op6_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return linked(messages).select("conv_id", "turn", "role", *RESULTS)


#: Patterns of its own, so that it doesn't share an error of those above. A far passage has four gaps between words or more.
_MARKS = "^([ \\t]*>)+"
_WROTE = "^[ \\t]*(On|Am|Le|El) [^\\n]{1,200}(wrote|schrieb|écrit|escribió)[^\\n]{0,80}:[ \\t]*$"
_WORD = "[^ \\t\\n\\x0B\\x0C\\r]"
_NORMAL = "trim(regexp_replace(lower(@), '[ \\t\\n\\x0B\\x0C\\r]+', ' ', 'g'))"
_HASH = f"md5({_NORMAL})"
_FAR = f"len(string_split({_NORMAL}, ' ')) > 4"
#: Rows are numbered, as (conv_id, turn) may repeat. @rows: the table's name.
SQL = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, replace(replace(replace(coalesce(text, ''), chr(30), ''), chr(31), ''), chr(13), '') AS t FROM @rows),
  sp AS (SELECT rid, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
  lv AS (SELECT rid, i, len(regexp_extract(x, '{_MARKS}', 0)) - len(replace(regexp_extract(x, '{_MARKS}', 0), '>', '')) AS level, regexp_replace(x, '{_MARKS}[ \\t]?', '') AS body FROM sp),
  ln AS (SELECT rid, i, body, CASE WHEN level = 0 AND lead(level) OVER (PARTITION BY rid ORDER BY i) > 0 AND regexp_matches(body, '{_WROTE}') THEN -1 ELSE level END AS level FROM lv),
  rn AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i) AS run FROM (SELECT *, level IS NOT DISTINCT FROM lag(level) OVER (PARTITION BY rid ORDER BY i) AS same FROM ln)),
  ps AS (SELECT rid, run, any_value(level) AS level, string_agg(body, chr(10) ORDER BY i) AS p FROM rn GROUP BY 1, 2),
  bd AS (SELECT rid, regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (level = 0), ''), '^[ \\t\\n\\x0B\\x0C\\r]+|[ \\t\\n\\x0B\\x0C\\r]+$', '', 'g') AS body, greatest(max(level), 0) AS max_level FROM ln GROUP BY 1),
  nq AS (SELECT rid, count(*) FILTER (level > 0) AS n_quotes FROM ps GROUP BY 1),
  ky AS (SELECT rid, level, 0 AS rank, {_FAR.replace("@", "p")} AS far, {_HASH.replace("@", "p")} AS h FROM ps WHERE level >= 0 AND regexp_matches(p, '{_WORD}')
    UNION SELECT rid, level, 1, false, {_HASH.replace("@", "body")} FROM rn WHERE level >= 0 AND regexp_matches(body, '{_WORD}')
    UNION SELECT rid, 0, 0, false, {_HASH.replace("@", "body")} FROM bd),
  k AS (SELECT DISTINCT conv_id AS c, turn AS t, level, rank, far, h FROM ky JOIN d USING (rid) WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
  nodes AS (SELECT DISTINCT conv_id AS c, turn AS t FROM d WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
  pos AS (SELECT c, t, lag(t) OVER w AS prev, row_number() OVER w - 1 AS position FROM nodes WINDOW w AS (PARTITION BY c ORDER BY t)),
  fnd AS (SELECT q.c, q.t, q.level, q.rank, coalesce((SELECT struct_pack(c := o.c, t := min(o.t)) FROM k o WHERE o.level = 0 AND o.h = q.h AND o.c = q.c AND o.t < q.t GROUP BY o.c),
    (SELECT min(struct_pack(c := o.c, t := o.t)) FROM k o WHERE q.far AND o.level = 0 AND o.h = q.h AND o.c < q.c)) AS dest FROM k q WHERE q.level > 0),
  lk AS (SELECT c, t, arg_min(dest, (level, rank, dest)) AS dest, count(*) FILTER (rank = 0) AS n_linked FROM fnd WHERE dest IS NOT NULL GROUP BY 1, 2),
  up AS (SELECT pos.c, pos.t, position, coalesce(n_linked, 0) AS n_linked, CASE WHEN dest IS NOT NULL THEN dest.c WHEN prev IS NOT NULL THEN pos.c END AS uc, CASE WHEN dest IS NOT NULL THEN dest.t ELSE prev END AS ut FROM pos LEFT JOIN lk ON pos.c = lk.c AND pos.t = lk.t),
  th(c, t, rc, rt, depth) AS (SELECT c, t, c, t, 0::BIGINT FROM up WHERE uc IS NULL UNION ALL SELECT up.c, up.t, rc, rt, depth + 1 FROM up JOIN th ON up.uc = th.c AND up.ut = th.t)
  SELECT conv_id, turn, role, body, n_quotes, coalesce(n_linked, 0) AS n_linked, max_level, uc AS reply_conv, ut AS reply_turn, rc AS root_conv, rt AS root_turn, depth, position
  FROM d JOIN bd USING (rid) JOIN nq USING (rid) LEFT JOIN up ON conv_id = up.c AND turn = up.t LEFT JOIN th ON conv_id = th.c AND turn = th.t"""
