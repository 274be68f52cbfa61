"""Weakly supervised quality rules in DataFrame expressions (operator 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stored, table

#: A word, and the characters that count as symbols.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50

#: Rule name -> (votes good if, votes bad if), SQL over the statistics; neither: it abstains. Bad is tested first.
RULES = {
    "length": ("n_words between 50 and 200000", "n_words < 5"),
    "word_length": ("word_chars between 3.5 * n_words and 7 * n_words", "word_chars < 2.5 * n_words or word_chars > 10 * n_words"),
    "symbols": ("50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    "lines": ("n_lines >= 3 and 10 * n_dup_lines < n_lines", "n_lines >= 3 and 2 * n_dup_lines > n_lines"),
    "style": ("n_letters >= 20 and 10 * n_upper < n_letters and 20 * n_shouts < n_words", "n_letters >= 20 and (10 * n_upper > 4 * n_letters or 10 * n_shouts > 3 * n_words)"),
    "letters": ("4 * n_letters >= 3 * word_chars", "2 * n_letters < word_chars"),
}
#: Iterations; the share of good documents and the rules' accuracies on good and on bad ones before any, in so many pseudo-votes;
#: and the ranges that accuracies may take. Rules are written to be right on good documents; each knows one defect,
#: so on bad ones it may well be wrong. Rules of one defect are one rule: votes count as independent.
ROUNDS, PRIOR_GOOD, RIGHT_GOOD, RIGHT_BAD, PRIOR_VOTES = 20, 0.7, 0.99, 0.2, 20.0
GOOD_RANGE, BAD_RANGE = (0.98, 0.9995), (0.02, 0.98)
STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_shouts", "n_letters")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts of STATS, all long. Null counts as the empty text, where each is 0.

    Whole texts are read in one pass and no row leaves its task. Word windows are compared by 64-bit hash
    within one text; sorting them keeps the cost at n log n for any length.
    """
    columns = [c for c in docs.columns if c not in STATS]
    d = docs.select(*columns, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    d = d.select("*", F.expr(rf"filter(split(__t, r'{SPACE}'), w -> w <> '')").alias("__w"), F.expr(rf"filter(split(__t, '\n'), l -> l rlike r'[^\x20\x09-\x0D]')").alias("__l"))
    windows = "if(size(__w) >= 3, transform(sequence(0, size(__w) - 3), i -> named_struct('h', xxhash64(__w[i], __w[i + 1], __w[i + 2]), 'i', i)), array())"
    d = d.select("*", F.expr(f"sort_array(cast({windows} as array<struct<h: bigint, i: int>>))").alias("__s"))
    d = d.select("*", F.expr("sort_array(transform(filter(__s, (x, i) -> x.h = get(__s, i - 1).h or x.h = get(__s, i + 1).h), x -> x.i))").alias("__r"))
    count = lambda e: F.expr(f"cast({e} as bigint)")
    return d.select(
        *columns,
        count("size(__w)").alias("n_words"),
        count("length(array_join(__w, ''))").alias("word_chars"),
        count(f"regexp_count(__t, r'[{SYMBOLS}]')").alias("n_symbols"),
        count("size(__l)").alias("n_lines"),
        count("size(__l) - size(array_distinct(__l))").alias("n_dup_lines"),
        count("aggregate(__r, named_struct('at', -3, 'n', 0), (a, s) -> named_struct('at', s, 'n', a.n + least(3, s - a.at)), a -> a.n)").alias("n_repeat_words"),
        count(r"length(__t) - length(regexp_replace(__t, r'\p{Lu}+', ''))").alias("n_upper"),
        count("length(__t) - length(replace(__t, '!', ''))").alias("n_shouts"),
        count(r"length(regexp_replace(__t, r'\P{L}+', ''))").alias("n_letters"),
    )


def vote_code() -> Column:
    """All votes of a document as one number: a base-3 digit a rule, 0 abstains, 1 good, 2 bad."""
    return F.expr(" + ".join(f"{3**j} * (case when {bad} then 2 when {good} then 1 else 0 end)" for j, (good, bad) in enumerate(RULES.values()))).cast("long")


def posteriors(patterns: DataFrame) -> DataFrame:
    """(votes, quality) for a table (votes, n) of vote patterns and how many documents have each.

    Expectation-maximisation of a two-class model: each rule has an accuracy on good and one on bad
    documents, abstentions say nothing. It runs inside one expression over the array of patterns, of which
    there are at most 3 to the number of rules whatever the corpus, so that is the bound of the one row.
    Pseudo-votes keep a rule that rarely votes near the prior accuracy, and accuracies on good documents stay high,
    which fixes which class is the good one. No pattern at all gives no row.
    """
    k = len(RULES)
    votes = F.expr(f"transform(sequence(0, {k - 1}), j -> cast(floor(votes / power(3, j)) % 3 as int))")
    rows = patterns.select("votes", "n", votes.alias("v"))
    every = rows.agg(F.sort_array(F.collect_list(F.struct("votes", "v", F.col("n").cast("double").alias("w")))).alias("ps")).where("size(ps) > 0")
    # a state holds log-odds: of the classes, of a good vote and of a bad vote of each rule
    score = "1D / (1D + exp(-(st.b + aggregate(zip_with(x.v, zip_with(st.g, st.d, (g, d) -> named_struct('g', g, 'd', d)), (v, y) -> case v when 1 then y.g when 2 then y.d else 0D end), 0D, (a, y) -> a + y))))"
    scored = f"transform(ps, x -> named_struct('v', x.v, 'w', x.w, 'r', {score}))"
    total = lambda what: f"aggregate(q, 0D, (a, x) -> a + {what})"
    clamp = lambda e, at: f"least({at[1]}D, greatest({at[0]}D, {e}))"
    good = clamp(f"({total('if(x.v[j] = 1, x.w * x.r, 0D)')} + {PRIOR_VOTES * RIGHT_GOOD}D) / ({total('if(x.v[j] <> 0, x.w * x.r, 0D)')} + {PRIOR_VOTES}D)", GOOD_RANGE)
    bad = clamp(f"({total('if(x.v[j] = 2, x.w * (1D - x.r), 0D)')} + {PRIOR_VOTES * RIGHT_BAD}D) / ({total('if(x.v[j] <> 0, x.w * (1D - x.r), 0D)')} + {PRIOR_VOTES}D)", BAD_RANGE)
    share = f"({total('x.w * x.r')} + {PRIOR_VOTES * PRIOR_GOOD}D) / ({total('x.w')} + {PRIOR_VOTES}D)"
    rates = f"named_struct('p', {share}, 'a', transform(sequence(0, {k - 1}), j -> named_struct('g', {good}, 'b', {bad})))"
    state = "named_struct('b', ln(m.p / (1D - m.p)), 'g', transform(m.a, y -> ln(y.g / (1D - y.b))), 'd', transform(m.a, y -> ln((1D - y.g) / y.b)))"
    step = f"transform(transform(array({scored}), q -> {rates}), m -> {state})[0]"
    first = f"transform(array(named_struct('p', {PRIOR_GOOD}D, 'a', array_repeat(named_struct('g', {RIGHT_GOOD}D, 'b', {RIGHT_BAD}D), {k}))), m -> {state})[0]"
    fitted = every.select("ps", F.expr(f"aggregate(sequence(1, {ROUNDS}), {first}, (st, i) -> {step})").alias("st"))
    return fitted.select(F.explode(F.expr(f"transform(ps, x -> named_struct('votes', x.votes, 'quality', {score}))")).alias("x")).select("x.votes", "x.quality")


def quality_rules(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Adds STATS, base_failed, votes, quality and kept to the columns of docs; clashing columns are replaced.

    base_failed: fewer than MIN_WORDS words, or over half of them in three-word windows found twice. The
    rules of RULES vote good or bad or abstain; `quality` is the posterior probability of a good document
    under accuracies that expectation-maximisation estimates over all documents of the input. kept: not
    base_failed and quality at least `threshold`. Texts are read once: counts go to the shared folder, and
    the pattern table, of at most 3^6 rows, is the only broadcast. An empty table gives an empty table.
    """
    added = ("base_failed", "votes", "quality", "kept")
    return rated(statistics(docs.select(*[c for c in docs.columns if c not in added]), text), threshold)


def rated(counted: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The second half of quality_rules, for rows that have STATS: votes, model, verdicts."""
    counted = stored(counted.withColumn("votes", vote_code()))
    quality = posteriors(counted.groupBy("votes").agg(F.count("*").alias("n")))
    failed = F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words")
    return counted.join(F.broadcast(quality), "votes").withColumns({"base_failed": failed, "kept": ~failed & (F.col("quality") >= threshold)})


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, verdict and posterior of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = statistics(docs).drop("text")
    out = rated(counted)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 4).alias("quality"))


def _oracle() -> str:
    k = len(RULES)
    word = r"[^\x20\x09-\x0D]+"
    case = " + ".join(f"{3**j} * (case when {bad} then 2 when {good} then 1 else 0 end)" for j, (good, bad) in enumerate(RULES.values()))
    sql = rf"""with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '{word}') as ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{word}')) as ls from d),
tri as (select r, i, struct_pack(a := ws[i], b := ws[i + 1], c := ws[i + 2]) as x from (select r, ws, unnest(generate_series(1, len(ws) - 2)) as i from w)),
starts as (select r, i from (select r, i, count(*) over (partition by r, x) as n from tri) where n > 1),
covered as (select r, count(distinct j) as n from (select r, unnest([i, i + 1, i + 2]) as j from starts) group by r),
st as (select r, doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')) as n_symbols,
  len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(n, 0) as n_repeat_words, length(t) - length(regexp_replace(t, '\p{{Lu}}+', '', 'g')) as n_upper,
  length(t) - length(replace(t, '!', '')) as n_shouts, length(regexp_replace(t, '\P{{L}}+', '', 'g')) as n_letters from w left join covered using (r)),
vt as (select *, {case} as votes from st),
pat as (select votes, count(*)::double as w, {", ".join(f"votes // {3**j} % 3 as v{j}" for j in range(k))} from vt group by votes),
s0 as (select {PRIOR_GOOD}::double as p, {", ".join(f"{RIGHT_GOOD}::double as g{j}, {RIGHT_BAD}::double as b{j}" for j in range(k))})"""
    odds = "ln(p / (1 - p)) + " + " + ".join(f"case v{j} when 1 then ln(g{j} / (1 - b{j})) when 2 then ln((1 - g{j}) / b{j}) else 0 end" for j in range(k))
    clamp = lambda e, at: f"least({at[1]}, greatest({at[0]}, {e}))"
    for i in range(1, ROUNDS + 1):
        sums = ", ".join(
            clamp(f"(sum(case when v{j} = 1 then w * r else 0 end) + {PRIOR_VOTES * RIGHT_GOOD}) / (sum(case when v{j} <> 0 then w * r else 0 end) + {PRIOR_VOTES})", GOOD_RANGE)
            + f" as g{j}, "
            + clamp(f"(sum(case when v{j} = 2 then w * (1 - r) else 0 end) + {PRIOR_VOTES * RIGHT_BAD}) / (sum(case when v{j} <> 0 then w * (1 - r) else 0 end) + {PRIOR_VOTES})", BAD_RANGE)
            + f" as b{j}"
            for j in range(k)
        )
        sql += f",\nq{i} as materialized (select votes, w, {', '.join(f'v{j}' for j in range(k))}, 1 / (1 + exp(-({odds}))) as r from pat, s{i - 1}),\ns{i} as materialized (select (sum(w * r) + {PRIOR_VOTES * PRIOR_GOOD}) / (sum(w) + {PRIOR_VOTES}) as p, {sums} from q{i})"
    failed = f"(n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words)"
    return sql + f""",
f as (select votes, 1 / (1 + exp(-({odds}))) as quality from pat, s{ROUNDS})
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
  {failed} as base_failed, not {failed} and quality >= 0.5 as kept, round(quality, 4) as quality from vt join f using (votes)"""


ORACLE = {"op1_quality": _oracle()}
