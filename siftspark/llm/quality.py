"""Quality statistics of texts and the types they point to: prose, list, table or junk (problem 9).

Thresholds on statistics are noisy labelling functions: each votes for one type or abstains. Nobody labels anything; the
accuracies of the functions and the shares of the types are learned by expectation-maximization from how the functions
agree. A text's posterior depends on its votes only, so EM runs on the counts of distinct vote patterns: the corpus is
aggregated once, over all documents, into at most as many rows as there are patterns, whatever the number of documents.
Should there be very many patterns, the sums of a round are made where they lie (`_fit`).

Which words are common is learned from the corpus too (`common_words`): those in a tenth of the texts of a language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.functions.text import SPACE, presence, sql_presence
from siftspark.llm import tokensets as ts
from siftspark.runtime import stage

TYPES = ["prose", "list", "table", "junk"]

#: A word of letters is common if it is in this share of the texts of a language, and in at least so many of them.
COMMON_SHARE, COMMON_TEXTS = 0.1, 5
#: Vote patterns up to which EM runs on the driver.
PATTERNS = 1 << 18

#: Characters that a wrong decoding leaves behind: signs that no word contains (fixed values).
BROKEN = r"[\x{80}-\x{9f}\x{a2}-\x{b4}\x{b6}-\x{bf}\x{c2}\x{c3}\x{e2}\x{20ac}\x{2122}\x{fffd}]"
LINE = r"\r\n?|[\n\x0b\x0c\x{85}\x{2028}\x{2029}]"

_BULLET = r"^[ \t>]*([-*+•‣·]|[0-9]{1,3}[.)]|\[[ xX]\])[ \t]+[^ \t]"
_COLUMNS = r"(\t.*\t)|(\|.*\|)|(;.*;)|( & .*(&|\\\\))|([^ ] {2,}[^ ].* {2,}[^ ])|(^[^ ,]*,[^ ]*$)|(\|)|(\t)|(\" *;)"
_KEYED = r"^[ \t>]*[A-Za-z_0-9]+ *[:=] *[^ ]+( [^ ]+)?$"
_DUMP = r"^[0-9a-fA-F]{4,}[ :]+([0-9a-fA-F]{2}[ ]+){4,}"


def _count(words: Column, test) -> Column:
    return F.size(F.filter(words, test)).cast("long")


def _share(n: Column, of: Column) -> Column:
    return F.when(of > 0, F.round(n / of, 6)).otherwise(F.lit(0.0))


def _bare(w: Column) -> Column:
    """A word in lower case without what isn't a letter or digit at its ends."""
    return F.lower(F.regexp_replace(w, r"^[^\pL\pN]+|[^\pL\pN]+\z", ""))


def common_words(documents: DataFrame) -> list[str]:
    """Words of letters that stand in at least COMMON_SHARE of the texts of a language, and in COMMON_TEXTS of them.

    Texts without `lang` are a language of their own, blank ones don't count. A text of w different words counts w times,
    so a language has at most w / COMMON_SHARE common words, w being the mean of its texts: the bound of what the driver
    gets. Counts are over whole texts of all documents, combined map-side.
    """
    lang = F.coalesce("lang", F.lit("")) if "lang" in documents.columns else F.lit("")
    d = documents.where(presence(F.col("text")).isNotNull()).select(lang.alias("_g"), F.array_distinct(F.transform(F.split("text", f"{SPACE}+"), _bare)).alias("_w"))
    texts = F.lit("")  # counts the text itself: no word of letters is empty
    words = d.select("_g", F.explode(F.array_append(F.filter("_w", lambda w: w.rlike(r"^\pL+\z")), texts)).alias("w"))
    counts = stage(words.groupBy("_g", "w").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= COMMON_TEXTS), "words")
    sizes = counts.where("w = ''").select("_g", F.col("k").alias("n"))
    return sorted(r["w"] for r in counts.where("w <> ''").join(sizes, "_g").where(F.col("k") >= F.lit(COMMON_SHARE) * F.col("n")).select("w").distinct().collect())


def statistics(documents: DataFrame, keep: list[str] | None = None, common: list[str] | None = None) -> DataFrame:
    """Per document with a text that isn't blank: doc_id, the columns ``keep`` and the statistics of its whole text.

    n_chars counts code points, words are what white space parts, lines those that aren't blank; all shares are rounded
    to six digits and 0 where there is nothing to share. Null and blank texts give no row. ``common`` are the common
    words, by default those of ``documents``.
    """
    common = common_words(documents) if common is None else common
    d = documents.where(presence(F.col("text")).isNotNull()).select(*dict.fromkeys(["doc_id", *(keep or [])]), F.col("text").alias("_t"))
    d = d.withColumn("_w", F.filter(F.split("_t", f"{SPACE}+"), lambda w: w != ""))
    d = d.withColumn("_l", F.filter(F.transform(F.split("_t", LINE), lambda x: F.regexp_replace(x, rf"{SPACE}+\z", "")), lambda x: x != ""))
    d = d.withColumn("n_words", F.size("_w").cast("long")).withColumn("n_lines", F.size("_l").cast("long"))
    solid = F.aggregate("_w", F.lit(0).cast("long"), lambda a, w: a + F.length(w))
    lines, words, n, m = F.col("_l"), F.col("_w"), F.col("n_words"), F.col("n_lines")
    d = d.withColumn("n_chars", F.length("_t").cast("long")).withColumn("_s", solid)
    return d.select(
        *dict.fromkeys(["doc_id", *(keep or [])]),
        "n_chars", "n_words", "n_lines",
        _share(F.col("_s"), n).alias("mean_word_length"),
        _share(F.length(F.regexp_replace("_t", rf"[\pL\pN]|{SPACE}", "")), F.col("_s")).alias("symbol_ratio"),
        _share(F.length(F.regexp_replace("_t", r"[^0-9]", "")), F.col("_s")).alias("digit_ratio"),
        _share(_count(lines, lambda x: x.rlike(r"[.!?…][\"'”’)]*\z")), m).alias("lines_ending_in_punctuation"),
        _share(_count(words, lambda w: _bare(w).isin(common)), n).alias("common_words"),
        _share(_count(words, lambda w: w.rlike(r"^[(\"'„“]*\pL[\pL’'-]*[.,;:!?)\"'”“]*\z")), n).alias("plain_words"),
        _share(_count(words, lambda w: w.rlike(rf"\pL{BROKEN}|{BROKEN}\pL|^{BROKEN}")), n).alias("broken_words"),
        _share(_count(words, lambda w: _bare(w).rlike(r"^[b-df-hj-np-tv-z]{5,}|[b-df-hj-np-tv-xz]{5}")), n).alias("unspeakable_words"),
        _share(_count(words, lambda w: w.rlike(r"\pL[.!?][\"')]*\z|\)[.!?]\z")), n).alias("sentence_ends"),
        _share(F.size(F.array_distinct(words)), n).alias("distinct_words"),
        _share(_count(words, lambda w: w.rlike(r"[,;]\z")), n).alias("comma_words"),
        _share(_count(lines, lambda x: x.rlike(_BULLET)), m).alias("bullet_lines"),
        _share(_count(lines, lambda x: x.rlike(_COLUMNS)), m).alias("column_lines"),
        _share(_count(lines, lambda x: x.rlike(_KEYED)), m).alias("keyed_lines"),
        _share(_count(lines, lambda x: x.rlike(_DUMP)), m).alias("dump_lines"),
        _share(_count(lines, lambda x: x.rlike(r"^[ \t>]*[^ \t]+([ \t]+[^ \t]+){0,3}\z") & ~x.rlike(r"[.!?]\z")), m).alias("short_lines"),
    )


_NOT_PROSE = ("list", "table", "junk")
#: Name, condition, and the types the function then votes for; the first condition that holds counts, else it abstains.
FUNCTIONS: list[tuple[str, list[tuple[str, tuple[str, ...]]]]] = [
    ("common", [("common_words >= 0.25 and broken_words < 0.1", ("prose",)), ("common_words <= 0.2", _NOT_PROSE)]),
    ("sentences", [("sentence_ends >= 0.03 and broken_words < 0.1", ("prose",)), ("sentence_ends <= 0.01 and n_words >= 4", _NOT_PROSE)]),
    ("endings", [("lines_ending_in_punctuation >= 0.5 and common_words >= 0.15 and broken_words < 0.1", ("prose",)), ("lines_ending_in_punctuation <= 0.05 and n_lines >= 4", _NOT_PROSE)]),
    ("broken", [("broken_words >= 0.15", ("junk",))]),
    ("stray", [("plain_words <= 0.78 and sentence_ends >= 0.03", ("junk",))]),
    ("bullets", [("bullet_lines >= 0.6 and common_words < 0.25", ("list",))]),
    ("keyed", [("keyed_lines >= 0.6", ("list",))]),
    ("commas", [("comma_words >= 0.3", ("list",))]),
    ("short", [("short_lines >= 0.8 and n_lines >= 3", _NOT_PROSE)]),
    ("single", [("n_words <= 1.6 * n_lines and n_lines >= 3 and symbol_ratio between 0.02 and 0.4 and digit_ratio < 0.1", ("list",))]),
    ("terms", [("short_lines >= 0.8 and n_lines >= 3 and digit_ratio < 0.08 and column_lines < 0.3", ("list",))]),
    ("columns", [("column_lines >= 0.6 and n_lines >= 2 and common_words < 0.2", ("table",))]),
    ("figures", [("digit_ratio >= 0.2 and column_lines >= 0.3", ("table",))]),
    ("dump", [("dump_lines >= 0.3", ("junk",))]),
    ("symbols", [("symbol_ratio >= 0.35 and column_lines < 0.3", ("junk",)), ("symbol_ratio >= 0.35", ("table", "junk"))]),
    ("unspeakable", [("unspeakable_words >= 0.06 and common_words < 0.15", ("junk",))]),
    ("strange", [("plain_words >= 0.8 and common_words < 0.1 and n_lines <= 2 and comma_words < 0.2", ("junk",))]),
    ("long", [("mean_word_length >= 30", ("junk",))]),
    ("repeated", [("distinct_words <= 0.1", ("junk",))]),
]
ROUNDS = 50


def votes(stats: DataFrame) -> DataFrame:
    """``stats`` with `votes`: per labelling function 0 (abstains) or the number of the condition that held."""
    one = []
    for _, conditions in FUNCTIONS:
        v = F.lit(0)
        for i, (sql, _) in reversed(list(enumerate(conditions, 1))):
            v = F.when(F.expr(sql), F.lit(i)).otherwise(v)
        one.append(v.cast("byte"))
    return stats.withColumn("votes", F.array(*one))


def _reach() -> dict[tuple[int, int], np.ndarray]:
    return {(j, i): np.array([t in types for t in TYPES]) for j, (_, cs) in enumerate(FUNCTIONS) for i, (_, types) in enumerate(cs, 1)}


def _start() -> tuple[np.ndarray, np.ndarray]:
    return np.full(len(FUNCTIONS), 0.8), np.full(len(TYPES), 1 / len(TYPES))


def _sums(v: np.ndarray, n: np.ndarray, acc: np.ndarray, prior: np.ndarray, reach) -> np.ndarray:
    """What a round needs of (votes, number of documents): documents of each type, and of each function the votes that
    hold the true type and all votes."""
    post = _posterior(v, acc, prior, reach)
    right, cast = np.zeros(len(acc)), np.zeros(len(acc))
    for (j, i), types in reach.items():
        at = v[:, j] == i
        right[j] += n[at] @ post[at][:, types].sum(axis=1)
        cast[j] += n[at].sum()
    return np.concatenate([n @ post, right, cast])


def _update(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k, m = len(TYPES), len(FUNCTIONS)
    of_type, right, cast = sums[:k], sums[k : k + m], sums[k + m :]
    return np.clip((right + 8) / (cast + 10), 0.55, 0.999), (of_type + 1) / (of_type.sum() + k)


def learn(patterns: list[tuple[list[int], int]], rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(accuracies, prior) by expectation-maximization on (votes, number of documents) patterns.

    A function votes for a set that holds the true type with its accuracy, else for one that doesn't, with a chance in
    proportion to the size of the set. Accuracies start at 0.8, are smoothed and kept between 0.55 and 0.999: functions
    are better than chance, which also settles which type is which.
    """
    acc, prior = _start()
    if not patterns:
        return acc, prior
    reach, v, n = _reach(), np.array([p for p, _ in patterns]), np.array([c for _, c in patterns], float)
    for _ in range(rounds):
        acc, prior = _update(_sums(v, n, acc, prior, reach))
    return acc, prior


def learn_spread(patterns: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """`learn` on a table of (votes, n): each round adds up partial sums of the table's parts, one row for each."""
    acc, prior = _start()
    names = [f"s{i}" for i in range(len(TYPES) + 2 * len(FUNCTIONS))]
    for _ in range(rounds):

        def part(batches, acc=acc, prior=prior):
            total, reach = np.zeros(len(names)), _reach()
            for b in batches:
                if b.num_rows:
                    v = b.column("votes").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(FUNCTIONS))
                    total += _sums(v, b.column("n").to_numpy().astype(float), acc, prior, reach)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names=names)

        sums = patterns.mapInArrow(part, ", ".join(f"{x} double" for x in names)).agg(*[F.sum(x) for x in names]).first()
        acc, prior = _update(np.array([x or 0.0 for x in sums]))
    return acc, prior


def _weights(acc: float, types: np.ndarray) -> np.ndarray:
    return np.log(np.where(types, acc, (1 - acc) * types.sum() / (len(types) - 1)))


def _posterior(v, acc, prior, reach) -> np.ndarray:
    score = np.tile(np.log(prior), (len(v), 1))
    for (j, i), types in reach.items():
        score[v[:, j] == i] += _weights(acc[j], types)
    score = np.exp(score - score.max(axis=1, keepdims=True))
    return score / score.sum(axis=1, keepdims=True)


def _fit(voted: DataFrame, most: int = PATTERNS) -> tuple[np.ndarray, np.ndarray]:
    """The model of all vote patterns: on the driver if there are at most ``most``, whose number depends on the functions
    and not on the documents, else in rounds over their table."""
    patterns = stage(voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")), "patterns")
    if patterns.count() > most:
        return learn_spread(patterns)
    return learn(sorted((list(r["votes"]), r["n"]) for r in patterns.collect()))


def _scored(voted: DataFrame, acc: np.ndarray, prior: np.ndarray) -> DataFrame:
    """(doc_id, votes, p_<type>..., type) of (doc_id, votes)."""
    reach = _reach()

    def run(batches):
        for b in batches:
            v = b.column("votes").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(FUNCTIONS))
            p = _posterior(v, acc, prior, reach)
            best = pa.array([TYPES[k] for k in p.argmax(axis=1)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("votes"), *[pa.array(p[:, k]) for k in range(len(TYPES))], best], names=names)

    names = ["doc_id", "votes", *[f"p_{t}" for t in TYPES], "type"]
    return voted.mapInArrow(run, ", ".join(["doc_id long, votes array<byte>", *[f"p_{t} double" for t in TYPES], "type string"]))


def _voted(documents: DataFrame) -> DataFrame:
    """(doc_id, votes). The statistics are written first: inlined into the functions they would be worked out again and again."""
    return votes(stage(statistics(documents), "statistics")).select("doc_id", "votes")


def typed(documents: DataFrame) -> DataFrame:
    """(doc_id, votes, p_prose, p_list, p_table, p_junk, type) of every document that isn't blank.

    The model is learned from all of ``documents``. Null and blank texts have no row; ties go to the first of TYPES; an
    empty table gives no rows; further columns, whatever their names, change nothing.
    """
    voted = _voted(documents)
    return _scored(voted, *_fit(voted))


def not_prose(documents: DataFrame) -> DataFrame:
    """(doc_id) of documents of dataset `context` whose posterior of being prose is below one half."""
    return typed(documents.where(F.col("dataset") == "context")).where("p_prose < 0.5").select("doc_id")


def halves(documents: DataFrame) -> DataFrame:
    """(half, type, other_type, n): the context documents of each half (by hash of doc_id), by their type under the model
    learned on that half and under the one learned on the other, which never saw them."""
    voted = stage(_voted(documents.where(F.col("dataset") == "context")).withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")), "voted")
    models = [_fit(voted.where(F.col("half") == h)) for h in (0, 1)]
    out = None
    for h in (0, 1):
        mine = voted.where(F.col("half") == h).select("doc_id", "votes")
        own, other = (_scored(mine, *models[m]).select("doc_id", F.col("type").alias(name)) for m, name in ((h, "type"), (1 - h, "other_type")))
        g = own.join(other, "doc_id").groupBy("type", "other_type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(h).alias("half"), "type", "other_type", "n")
        out = g if out is None else out.unionByName(g)
    return out


def function_accuracies(documents: DataFrame) -> DataFrame:
    """(function, accuracy, n_votes): what was learned of each labelling function, over all of dataset `context`."""
    voted = _voted(documents.where(F.col("dataset") == "context"))
    acc, _ = _fit(voted)
    cast = voted.select(F.posexplode("votes").alias("j", "vote")).groupBy("j").agg(F.count(F.when(F.col("vote") > 0, 1)).alias("n_votes"))
    known = [(j, name, round(float(acc[j]), 4)) for j, (name, _) in enumerate(FUNCTIONS)]
    names = voted.sparkSession.createDataFrame(known, "j int, function string, accuracy double")
    return names.join(cast, "j", "left").select("function", "accuracy", F.coalesce("n_votes", F.lit(0)).alias("n_votes"))


def _context(f):
    return lambda spark, folder: f(ts.documents(spark, folder))


def _sql_share(n: str, of: str) -> str:
    return f"CASE WHEN {of} > 0 THEN round(({n}) / ({of}), 6) ELSE 0 END"


def _sql_count(of: str, test: str) -> str:
    return f"len(list_filter({of}, lambda x: {test}))"


def _sql_match(pattern: str) -> str:
    return f"regexp_matches(x, '{pattern.replace(chr(39), chr(39) * 2)}')"


_BARE = r"lower(regexp_replace(x, '^[^\pL\pN]+|[^\pL\pN]+\z', '', 'g'))"
_SHARES = {
    "lines_ending_in_punctuation": _sql_share(_sql_count("l", _sql_match(r"[.!?…][\"'”’)]*\z")), "m"),
    "common_words": _sql_share(_sql_count("w", f"list_contains(cw, {_BARE})"), "n"),
    "plain_words": _sql_share(_sql_count("w", _sql_match(r"^[(\"'„“]*\pL[\pL’'-]*[.,;:!?)\"'”“]*\z")), "n"),
    "broken_words": _sql_share(_sql_count("w", _sql_match(rf"\pL{BROKEN}|{BROKEN}\pL|^{BROKEN}")), "n"),
    "unspeakable_words": _sql_share(_sql_count("w", f"regexp_matches({_BARE}, '^[b-df-hj-np-tv-z]{{5,}}|[b-df-hj-np-tv-xz]{{5}}')"), "n"),
    "sentence_ends": _sql_share(_sql_count("w", _sql_match(r"\pL[.!?][\"')]*\z|\)[.!?]\z")), "n"),
    "distinct_words": _sql_share("len(list_distinct(w))", "n"),
    "comma_words": _sql_share(_sql_count("w", _sql_match(r"[,;]\z")), "n"),
    "bullet_lines": _sql_share(_sql_count("l", _sql_match(_BULLET)), "m"),
    "column_lines": _sql_share(_sql_count("l", _sql_match(_COLUMNS)), "m"),
    "keyed_lines": _sql_share(_sql_count("l", _sql_match(_KEYED)), "m"),
    "dump_lines": _sql_share(_sql_count("l", _sql_match(_DUMP)), "m"),
    "short_lines": _sql_share(_sql_count("l", _sql_match(r"^[ \t>]*[^ \t]+([ \t]+[^ \t]+){0,3}\z") + " AND NOT " + _sql_match(r"[.!?]\z")), "m"),
}
ORACLE = {
    "p9_statistics": f"""WITH a AS (SELECT doc_id, text AS t, list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda x: x <> '') AS w,
        list_filter(list_transform(regexp_split_to_array(text, '{LINE}'), lambda x: regexp_replace(x, '{SPACE}+\\z', '')), lambda x: x <> '') AS l
        FROM documents WHERE dataset = 'context' AND {sql_presence('text')} IS NOT NULL),
      f AS (SELECT coalesce(lang, '') AS g, unnest(list_append(list_filter(list_distinct(list_transform(regexp_split_to_array(text, '{SPACE}+'), lambda x: {_BARE})), lambda x: regexp_matches(x, '^{chr(92)}pL+{chr(92)}z')), '')) AS x
        FROM documents WHERE dataset = 'context' AND {sql_presence('text')} IS NOT NULL),
      k AS (SELECT g, x, count(*) AS k FROM f GROUP BY 1, 2 HAVING count(*) >= {COMMON_TEXTS}),
      o AS (SELECT coalesce(list(DISTINCT a.x), []) AS cw FROM k a JOIN k b ON a.g = b.g AND b.x = '' AND a.x <> '' AND a.k >= {COMMON_SHARE}::DOUBLE * b.k),
      b AS (SELECT *, len(w) AS n, len(l) AS m, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS s FROM a, o)
      SELECT doc_id, length(t) AS n_chars, n AS n_words, m AS n_lines, {_sql_share('s', 'n')} AS mean_word_length,
        {_sql_share(f"length(regexp_replace(t, '[{chr(92)}pL{chr(92)}pN]|{SPACE}', '', 'g'))", 's')} AS symbol_ratio, {_sql_share("length(regexp_replace(t, '[^0-9]', '', 'g'))", 's')} AS digit_ratio,
        {', '.join(f'{v} AS {k}' for k, v in _SHARES.items())} FROM b""",
}
QUERIES = {
    "p9_found": _context(not_prose),
    "p9_statistics": _context(lambda d: statistics(d.where(F.col("dataset") == "context"))),
    "p9_types": _context(lambda d: typed(d.where(F.col("dataset") == "context")).drop("votes")),
    "p9_functions": _context(function_accuracies),
    "p9_halves": _context(halves),
}
