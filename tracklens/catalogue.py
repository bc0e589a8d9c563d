"""Every query by name, and the SQL it is checked against."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens import model_sql as M
from tracklens import region_sql as Q
from tracklens.functions import regions as R
from tracklens.functions import text as X
from tracklens.functions.dates import created, month
from tracklens.operators import clusters as C
from tracklens.operators import encoders as E
from tracklens.operators import sentences as N
from tracklens.operators import similarity as S
from tracklens.operators import tagger as G
from tracklens.operators import topics as T
from tracklens.operators import wordvectors as V
from tracklens.plans import disentangle as L
from tracklens.plans import reports as P
from tracklens.plans.preprocess import preprocessed
from tracklens.sources import issues as I
from tracklens.sources.durable import shared_dir, stored
from tracklens.sources.fixtures import views, with_views
from tracklens.sources.matrix import read_matrix, write_matrix

PROJECT, KEY = "alpha", "alpha-5"
STOP_WORDS = ["the", "of", "and", "a", "in", "to", "is", "that", "de", "la", "le", "et", "der", "die", "und", "que", "el", "y", ".", ","]
ABOVE = 0.35

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    """Register a function of (views, session, folder) under its name."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(views(spark, sf_dir), spark, sf_dir)

        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# Reports -------------------------------------------------------------------------------------------------------------


@query(with_views(f"SELECT * FROM issues WHERE lower(project) = '{PROJECT}'"))
def issue_by_project(v, spark, sf):
    return I.issues_of_project(v["issues"], PROJECT)


@query(with_views(f"SELECT * FROM issues WHERE lower(issue_key) = '{KEY}' AND (SELECT count(*) FROM issues WHERE lower(issue_key) = '{KEY}') = 1"))
def issue_by_key(v, spark, sf):
    return I.issue_by_key(v["issues"], KEY)


@query(with_views(f"SELECT issue_key, component FROM issue_component WHERE lower(issue_key) LIKE '{PROJECT}%'"))
def component_rows_prefix(v, spark, sf):
    return I.rows_of_prefix(v["issue_component"], PROJECT)


@query(with_views(f"SELECT trim(l) AS label, count(*) AS n FROM (SELECT unnest(string_split_regex(labels, '[;,]')) AS l FROM issues WHERE lower(project) = '{PROJECT}' AND NOT labels = '') WHERE trim(l) <> '' GROUP BY 1"))
def label_count(v, spark, sf):
    return P.label_counts(v["issues"], PROJECT)


@query(with_views(f"SELECT component, count(*) AS n FROM issue_component WHERE lower(issue_key) LIKE '{PROJECT}%' AND component IS NOT NULL GROUP BY 1"))
def component_count(v, spark, sf):
    return P.component_counts(v["issue_component"], PROJECT)


@query(with_views(f"SELECT issue_key, create_time, version FROM issues JOIN issue_version USING (issue_key) WHERE lower(project) = '{PROJECT}'"))
def issue_version_join(v, spark, sf):
    return I.issues_of_project(v["issues"], PROJECT).join(v["issue_version"], "issue_key").select("issue_key", "create_time", "version")


@query(with_views(f"SELECT issue_key, create_time, component, assignee FROM issues JOIN issue_component USING (issue_key) WHERE lower(project) = '{PROJECT}'"))
def issue_component_join(v, spark, sf):
    return I.issues_of_project(v["issues"], PROJECT).join(v["issue_component"], "issue_key").select("issue_key", "create_time", "component", "assignee")


_RANKS = ("ranks", "SELECT version, release_date, row_number() OVER (ORDER BY release_date, ordinal)::INT AS version_rank FROM release_dim")
_CREATED = "CAST(substr(create_time, 1, length(create_time) - 9) AS TIMESTAMP)"
_ASSIGNED = ("assigned", f"SELECT issue_key, create_time, component, assignee FROM issues JOIN issue_component USING (issue_key) WHERE lower(project) = '{PROJECT}' AND create_time IS NOT NULL AND component IS NOT NULL AND assignee IS NOT NULL")
_PEOPLE = ("people", "SELECT assignee, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, assignee)::INT AS assignee_rank FROM assigned GROUP BY 1 QUALIFY row_number() OVER (ORDER BY count(*) DESC, assignee) BETWEEN 16 AND 20")
_TOPS = ("tops", "SELECT component, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, component)::INT AS component_rank FROM assigned GROUP BY 1 QUALIFY row_number() OVER (ORDER BY count(*) DESC, component) <= 10")


@query(with_views("SELECT * FROM ranks", _RANKS))
def release_rank(v, spark, sf):
    return P.release_ranks(v["release_dim"])


@query(with_views(f"SELECT issue_key, {_CREATED} AS created, version, version_rank FROM issues JOIN issue_version USING (issue_key) JOIN ranks USING (version) WHERE lower(project) = '{PROJECT}'", _RANKS))
def time_version_scatter(v, spark, sf):
    return P.time_by_version(v["issues"], v["issue_version"], v["release_dim"], PROJECT)


@query(with_views("SELECT version, CAST(release_date AS DATE) AS release_day, version_rank FROM ranks WHERE version = 'v4'", _RANKS))
def highlighted_release(v, spark, sf):
    return P.highlighted(v["release_dim"], "v4")


@query(with_views("SELECT assignee, count(*) AS n FROM assigned GROUP BY 1", _ASSIGNED))
def assignee_count(v, spark, sf):
    return P.frequency(P.assigned(v["issues"], v["issue_component"], PROJECT), "assignee")


@query(with_views("SELECT * FROM people", _ASSIGNED, _PEOPLE))
def assignee_rank_slice(v, spark, sf):
    return P.main_assignees(P.assigned(v["issues"], v["issue_component"], PROJECT))


@query(with_views("SELECT * FROM tops", _ASSIGNED, _TOPS))
def component_topk(v, spark, sf):
    return P.main_components(P.assigned(v["issues"], v["issue_component"], PROJECT))


@query(with_views(f"SELECT issue_key, {_CREATED} AS created, component, component_rank, assignee, row_number() OVER (PARTITION BY assignee ORDER BY create_time, issue_key, component) = 1 AS first_appearance FROM assigned JOIN people USING (assignee) JOIN tops USING (component)", _ASSIGNED, _PEOPLE, _TOPS))
def assignee_component_scatter(v, spark, sf):
    return P.assignee_by_component(v["issues"], v["issue_component"], PROJECT)


@query(with_views("SELECT count(*) AS points FROM assigned JOIN people USING (assignee) JOIN tops USING (component)", _ASSIGNED, _PEOPLE, _TOPS))
def point_count(v, spark, sf):
    return P.assignee_by_component(v["issues"], v["issue_component"], PROJECT).agg(F.count("*").alias("points"))


@query(with_views("SELECT issue_id, issue_key FROM issues WHERE issue_key NOT IN (SELECT issue_key FROM issues WHERE issue_id % 10 = 3)"))
def key_skip_list(v, spark, sf):
    return I.without_keys(v["issues"], v["issues"].where("issue_id % 10 = 3")).select("issue_id", "issue_key")


@query(with_views("SELECT assignee, create_time, issue_key, component FROM assigned QUALIFY row_number() OVER (PARTITION BY assignee ORDER BY create_time, issue_key, component) = 1", _ASSIGNED))
def first_appearance(v, spark, sf):
    return P.first_appearances(P.assigned(v["issues"], v["issue_component"], PROJECT))


@query(with_views(f"SELECT issue_key, {_CREATED} AS created, strftime({_CREATED}, '%Y-%m') AS month FROM issues"))
def parse_create_time(v, spark, sf):
    return v["issues"].select("issue_key", created().alias("created"), month(created()).alias("month"))


# Text ----------------------------------------------------------------------------------------------------------------

_SPACE = Q.SPACE
_URL = rf"https?://[^{_SPACE}]+"


def _places(name: str, text: str, pattern: str, source: str = "issues") -> tuple[str, str]:
    """A view issue_id, ord, start, end, hit of all matches of a pattern."""
    return name, f"""SELECT issue_id, o AS ord, (list_sum(list_transform(g[1:o], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:o - 1], lambda x: length(x))), 0))::INT AS "start", "start" + length(m[o])::INT AS "end", m[o] AS hit
 FROM (SELECT issue_id, m, g, unnest(range(1, len(m) + 1)) AS o FROM (SELECT issue_id, regexp_extract_all({text}, '{pattern}') AS m, string_split_regex({text}, '{pattern}') AS g FROM {source} WHERE {text} IS NOT NULL))"""


def _exploded(v, regions) -> DataFrame:
    return v["issues"].select("issue_id", F.explode(regions(F.col("description"))).alias("r")).select("issue_id", "r.start", "r.end", "r.tag", "r.content")


_URLS = _places("urls", "description", _URL)
_NOFORMAT = _places("noformats", "description", r"(?s)\{noformat\}.*?\{noformat\}")
_CODES = _places("codes", "description", r"(?s)\{code.*?\}.*?\{code.*?\}")
_COLOURS = _places("colours", "description", r"(?s)\{color.*?\}.*?\{color.*?\}")
_COMMENTS = _places("comments", "description", rf"(?s)[{_SPACE}]*//.*?[\n\r]")
_EXPLICIT = ("explicits", """SELECT issue_id, 0 AS kind, "start", "end", '{noformat}' AS tag, substr(hit, 11, length(hit) - 20) AS content FROM noformats
 UNION ALL SELECT issue_id, 1, "start", "end", regexp_extract(hit, '(?s)^\\{code.*?\\}') AS tag, substr(hit, length(tag) + 1, length(hit) - length(tag) - 6) FROM codes""")


@query(with_views("""SELECT issue_id, "start", "end", 'url' AS tag, hit AS content FROM urls""", _URLS))
def url_regions(v, spark, sf):
    return _exploded(v, X.url_regions)


@query(with_views("""SELECT issue_id, "start", "end", tag, content FROM explicits""", _NOFORMAT, _CODES, _EXPLICIT))
def explicit_code_regions(v, spark, sf):
    return _exploded(v, X.code_regions)


@query(with_views("""SELECT issue_id, "start", "end", regexp_extract(hit, '(?s)^\\{color.*?\\}') AS tag, substr(hit, length(tag) + 1, length(hit) - length(tag) - 7) AS content FROM colours""", _COLOURS))
def colour_regions(v, spark, sf):
    return _exploded(v, X.colour_regions)


_STRIPPED = r"""SELECT issue_id, CASE WHEN c IS NULL THEN description ELSE string_agg(gap || CASE WHEN o <= len(m) THEN ' ' || substr(m[o], length(regexp_extract(m[o], '(?s)^\{color.*?\}')) + 1, length(m[o]) - length(regexp_extract(m[o], '(?s)^\{color.*?\}')) - 7) || ' ' ELSE '' END, '' ORDER BY o) END AS stripped
 FROM (SELECT issue_id, description, m, g, len(g) AS c, unnest(range(1, len(g) + 1)) AS o, unnest(g) AS gap FROM (SELECT issue_id, description, regexp_extract_all(description, '(?s)\{color.*?\}.*?\{color.*?\}') AS m, string_split_regex(description, '(?s)\{color.*?\}.*?\{color.*?\}') AS g FROM issues WHERE description IS NOT NULL)) GROUP BY issue_id, description, c"""


@query(with_views(_STRIPPED))
def color_strip(v, spark, sf):
    return v["issues"].where("description IS NOT NULL").select("issue_id", X.without_colour(F.col("description")).alias("stripped"))


@query(with_views("""SELECT issue_id, min("start") AS "start", max("end") AS "end", string_agg(tag, ',' ORDER BY rn) FILTER (fresh) AS tag FROM (
 SELECT *, sum(CASE WHEN before IS NULL OR "start" > before THEN 1 ELSE 0 END) OVER (PARTITION BY issue_id ORDER BY rn) AS island, before IS NULL OR "end" > before AS fresh FROM (
 SELECT *, max("end") OVER (PARTITION BY issue_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (
 SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY "start", kind) AS rn FROM (SELECT issue_id, -1 AS kind, "start", "end", 'url' AS tag FROM urls UNION ALL SELECT issue_id, kind, "start", "end", tag FROM explicits)))) GROUP BY issue_id, island""", _URLS, _NOFORMAT, _CODES, _EXPLICIT))
def region_merge(v, spark, sf):
    return _exploded(v, lambda t: X.merged(F.concat(X.url_regions(t), X.code_regions(t)))).select("issue_id", "start", "end", "tag")


@query(with_views("""SELECT issue_id, "start", "end", hit AS content FROM comments c WHERE NOT EXISTS (SELECT 1 FROM urls u WHERE u.issue_id = c.issue_id AND u."start" < c."start" AND c."start" < u."end")""", _URLS, _COMMENTS))
def url_comment_exclusion(v, spark, sf):
    return _exploded(v, lambda t: X.comments_outside_urls(X.line_comments(t), X.url_regions(t))).select("issue_id", "start", "end", "content")


@query(with_views("""SELECT issue_id, opening, coalesce(min("end") FILTER (hit = '}' AND level = 0) - opening, 0)::INT AS characters FROM (
 SELECT *, sum(CASE hit WHEN '{' THEN 1 ELSE -1 END) OVER (PARTITION BY issue_id ORDER BY ord) AS level FROM (
 SELECT *, min("start") FILTER (hit = '{') OVER (PARTITION BY issue_id) AS opening FROM braces) WHERE "start" >= opening) GROUP BY 1, 2""", _places("braces", "description", "[{}]")))
def brace_match(v, spark, sf):
    rows = v["issues"].select("issue_id", "description", (F.instr("description", "{") - 1).alias("opening")).where("opening >= 0")
    return rows.select("issue_id", "opening", X.brace_match(F.col("description"), F.col("opening")).alias("characters"))


_TOKEN = X.TOKEN.removeprefix("(?U)").replace(r"\w", r"[\p{L}\p{N}_]").replace(r"\d", r"\p{Nd}").replace("'", "''")
_TOKENS = ("tokens", f"SELECT issue_id, list_transform(regexp_extract_all(summary, '{_TOKEN}'), lambda x: lower(x)) AS t FROM issues WHERE summary IS NOT NULL")
_STOP = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"
_KEPT = ("kept", f"SELECT issue_id, list_filter(t, lambda x: NOT x IN {_STOP} AND NOT regexp_matches(x, '{X.NUMBER}')) AS t FROM tokens")


@query(with_views("SELECT issue_id, len(t)::INT AS n, array_to_string(t, ' ') AS tokens FROM tokens", _TOKENS))
def tokenize_sentence(v, spark, sf):
    t = v["issues"].where("summary IS NOT NULL").select("issue_id", X.tokens(F.col("summary")).alias("t"))
    return t.select("issue_id", F.size("t").alias("n"), F.array_join("t", " ").alias("tokens"))


def _kept(v) -> DataFrame:
    return v["issues"].where("summary IS NOT NULL").select("issue_id", X.meaningful(X.tokens(F.col("summary")), STOP_WORDS).alias("t"))


@query(with_views("SELECT issue_id, len(t)::INT AS n, array_to_string(t, ' ') AS tokens FROM kept", _TOKENS, _KEPT))
def token_filter(v, spark, sf):
    return _kept(v).select("issue_id", F.size("t").alias("n"), F.array_join("t", " ").alias("tokens"))


@query(with_views(f"SELECT DISTINCT term, regexp_matches(term, '{X.NUMBER}') AS is_number FROM (SELECT unnest(t) AS term FROM tokens)", _TOKENS))
def is_number(v, spark, sf):
    terms = v["issues"].select(F.explode_outer(X.tokens(F.col("summary"))).alias("term")).where("term IS NOT NULL").distinct()
    return terms.select("term", X.is_number(F.col("term")).alias("is_number"))


@query(with_views("SELECT term, count(*) AS n FROM (SELECT unnest(t) AS term FROM kept) GROUP BY 1", _TOKENS, _KEPT))
def term_frequency(v, spark, sf):
    # Spark would ask explode() for lists that aren't empty, and make each list twice.
    terms = v["issues"].where("summary IS NOT NULL").select(F.explode_outer(X.tokens(F.col("summary"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return terms.where(F.col("term").isNotNull() & ~F.col("term").isin(STOP_WORDS) & ~X.is_number(F.col("term")))


_OFTEN = ("often", "SELECT word FROM (SELECT unnest(t) AS word FROM tokens) GROUP BY 1 ORDER BY count(*) DESC, word LIMIT 30")


@query(with_views("SELECT word, count(*) AS n FROM (SELECT unnest(t) AS word FROM tokens) WHERE word NOT IN (SELECT word FROM often) GROUP BY 1", _TOKENS, _OFTEN))
def corpus_stop_words(v, spark, sf):
    """How often words occur besides the 30 most frequent ones, which are kept as a list in a file."""
    terms = stored(v["issues"].select(F.explode_outer(X.tokens(F.col("summary"))).alias("word")).where("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("n")), "terms")
    path = f"{shared_dir(spark)}/stop-words-{uuid.uuid4().hex}"
    I.append_lines(terms.orderBy(F.desc("n"), "word").limit(30).select("word"), path)
    return terms.where(~F.col("word").isin(I.read_stop_words(spark, path)))


_SENTENCES = (("sources", "SELECT issue_id AS id, summary AS text FROM issues WHERE summary IS NOT NULL"), *M.sentences("sources", _SPACE))


def _sources(v) -> DataFrame:
    return v["issues"].where("summary IS NOT NULL").select(F.col("issue_id").alias("id"), F.col("summary").alias("text"))


@query(with_views(f"SELECT id AS issue_id, sentence, array_to_string(list_transform(regexp_extract_all(text, '{_TOKEN}'), lambda x: lower(x)), ' ') AS tokens FROM sentences", *_SENTENCES, once=True))
def paragraph_tokens(v, spark, sf):
    return N.sentences(_sources(v)).select(F.col("id").alias("issue_id"), "sentence", X.token_line(F.col("text")).alias("tokens"))


@query(with_views("SELECT word, dotted, plain, small, capital, score FROM word_counts LEFT JOIN (SELECT word, round(score, 6) AS score FROM abbreviations) USING (word)", *_SENTENCES, once=True))
def sentence_statistics(v, spark, sf):
    """What sentence boundaries are learned from; abbreviations have a score."""
    counts = stored(N.counted(N.pieces(_sources(v))), "word-counts")
    return counts.join(N.abbreviations(counts), "word", "left").withColumn("score", F.round("score", 6))


@query(with_views("SELECT DISTINCT assignee, '#' || upper(substr(md5(assignee), 1, 6)) AS colour FROM issues WHERE assignee IS NOT NULL"))
def assignee_colour(v, spark, sf):
    return v["issues"].where("assignee IS NOT NULL").select("assignee").distinct().withColumn("colour", X.colour_of(F.col("assignee")))


def _cleaned(text: str) -> list[tuple[str, str]]:
    """Views up to ``cleaned`` for a column of the issues."""
    explicit = _EXPLICIT[1].replace("0 AS kind", "0 AS kind, ord").replace("SELECT issue_id, 1,", "SELECT issue_id, 1, ord,")
    return [
        ("stripped", f"SELECT issue_id, stripped AS s FROM ({_STRIPPED.replace('description', text)})"),
        _places("urls", "s", _URL, "stripped"),
        _places("noformats", "s", r"(?s)\{noformat\}.*?\{noformat\}", "stripped"),
        _places("codes", "s", r"(?s)\{code.*?\}.*?\{code.*?\}", "stripped"),
        ("explicits", explicit),
        *Q.cleaned(),
    ]


@query(with_views("SELECT issue_id, coalesce(s, '') AS raw, coalesce(n_regions, 0)::INT AS n_regions, coalesce(cleaned, '') AS cleaned, NULL::VARCHAR AS error FROM issues LEFT JOIN stripped USING (issue_id) LEFT JOIN cleaned USING (issue_id)", *_cleaned("description")))
def clean_text(v, spark, sf):
    rows = v["issues"].select("issue_id", R.clean_text(F.col("description"), compat=True).alias("c"))
    return rows.select("issue_id", "c.raw", F.size("c.regions").alias("n_regions"), "c.cleaned", "c.error")


@query(with_views('SELECT issue_id, "start"::INT AS "start", "end"::INT AS "end", tag, content FROM outside', *_cleaned("description")))
def non_language_regions(v, spark, sf):
    return _exploded(v, lambda t: R.clean_text(t, compat=True)["regions"])


_WHOLE = ("whole", "SELECT issue_id, 0 AS part, description AS t FROM issues WHERE description IS NOT NULL")


@query(with_views('SELECT issue_id, "start"::INT AS "start", "end"::INT AS "end", tag, content FROM stack', _WHOLE, *Q.stack("whole")))
def stack_trace_regions(v, spark, sf):
    return _exploded(v, lambda t: R.found_regions(t, "stack", compat=True))


@query(with_views('SELECT issue_id, "start"::INT AS "start", "end"::INT AS "end", tag, content FROM code', _WHOLE, *Q.code("whole")))
def code_regions(v, spark, sf):
    return _exploded(v, lambda t: R.found_regions(t, "code", compat=True))


@query(with_views('SELECT issue_id, "start"::INT AS "start", "end"::INT AS "end", \'exception\' AS tag, substr(t, "start" + 1, "end" - "start") AS content FROM walk_heads JOIN whole USING (issue_id, part) WHERE last = "start"', _WHOLE, *Q.stack("whole")))
def exception_heads(v, spark, sf):
    return _exploded(v, lambda t: R.found_regions(t, "exception", compat=True))


def _words(v) -> DataFrame:
    """id, pos, word: the words of all texts."""
    return v["issues"].select(F.col("issue_id").alias("id"), F.posexplode_outer(X.tokens(F.col("summary"))).alias("pos", "word")).where("word IS NOT NULL")


_FORMS = " UNION ALL ".join(f"SELECT word, '{t}' AS tag, left(word, length(word) - {len(old)}) || '{new}' AS lemma FROM vocabulary WHERE word LIKE '%{old}' AND length(word) >= {len(old) - len(new) + 2}" for t, rules in G.DETACHED.items() for old, new in rules)


@query(with_views(f"SELECT word, tag, arg_min(lemma, (length(lemma), lemma)) AS lemma FROM ({_FORMS}) WHERE lemma IN (SELECT word FROM vocabulary) AND length(lemma) <= length(word) GROUP BY 1, 2", _TOKENS, ("vocabulary", "SELECT DISTINCT unnest(t) AS word FROM tokens")))
def lemma_forms(v, spark, sf):
    """For each word and part of speech the form in the vocabulary that it is a form of."""
    return G.lemma_table(_words(v))


@query()
def lemmas_of_words(v, spark, sf):
    """Parts of speech as trained on these texts, and lemmas."""
    return G.lemmatized(v["issues"].where("summary IS NOT NULL").select(F.col("issue_id").alias("id"), X.tokens(F.col("summary")).alias("tokens")))


_STATES = ", ".join(f"'{s}'" for s in G.STATES)
_LEMMAS = (
    ("texts", f"SELECT issue_id AS id, list_transform(regexp_extract_all(cleaned, '{_TOKEN}'), lambda x: lower(x)) AS tokens FROM cleaned"),
    ("vocabulary", "SELECT DISTINCT unnest(tokens) AS word FROM texts"),
    ("forms", f"SELECT word, tag, arg_min(lemma, (length(lemma), lemma)) AS lemma FROM ({_FORMS}) WHERE lemma IN (SELECT word FROM vocabulary) AND length(lemma) <= length(word) GROUP BY 1, 2"),
    *M.parts_of_speech("texts", G.HINTS, G.OTHERWISE, G.PRIOR, G.MORE, G.ROUNDS, G.GRAIN),
    ("lemmas", f"SELECT id, pos, coalesce(lemma, t.word) AS word FROM (SELECT *, ([{_STATES}])[state] AS tag FROM hmm_tags) t LEFT JOIN forms f ON f.word = t.word AND f.tag = t.tag"),
)


@query(with_views(f"""SELECT issue_id, coalesce(cleaned, '') AS cleaned, NULL::VARCHAR AS error, coalesce(tokens, '') AS tokens FROM issues LEFT JOIN cleaned USING (issue_id)
 LEFT JOIN (SELECT id, string_agg(word, ' ' ORDER BY pos) AS tokens FROM lemmas WHERE NOT word IN {_STOP} AND NOT regexp_matches(word, '{X.NUMBER}') GROUP BY 1) ON id = issue_id""", *_cleaned("summary"), *_LEMMAS, once=True))
def preprocess(v, spark, sf):
    """Words are lemmatized as trained on these texts before stop words and numbers go."""
    return preprocessed(v["issues"], STOP_WORDS, "learned", compat=True).select("issue_id", "cleaned", "error", F.array_join("tokens", " ").alias("tokens"))


# Vectors, clusters and their score -----------------------------------------------------------------------------------

_WORD_VECTORS = ("word_vectors", "SELECT vec_id, embedding FROM embeddings")
_MEANS = ("means", """SELECT issue_id AS id, pos, sum(n * x) / sum(n) AS x FROM (
 SELECT issue_id, n, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS x FROM (SELECT issue_id, length(w) AS len, count(*) AS n FROM (SELECT issue_id, unnest(t) AS w FROM kept) GROUP BY 1, 2) JOIN embeddings ON vec_id = len) GROUP BY 1, 2""")


@query(with_views("SELECT id, pos::INT AS pos, round(x, 6) + 0.0 AS x FROM means", _TOKENS, _KEPT, _MEANS))
def mean_vector(v, spark, sf):
    """Words of one length share a vector of the table, in place of a trained model."""
    words = v["issues"].select(F.col("issue_id").alias("id"), F.explode_outer(X.tokens(F.col("summary"))).alias("w"))
    words = words.where(F.col("w").isNotNull() & ~F.col("w").isin(STOP_WORDS) & ~X.is_number(F.col("w"))).select("id", F.length("w").cast("long").alias("word"))
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("word"), F.col("embedding").alias("v"))
    return S.mean_vectors(words, vectors).select("id", "pos", (F.round("x", 6) + F.lit(0.0)).alias("x"))


@query("SELECT vec_id AS id FROM embeddings WHERE len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) > 0")
def usable_vectors(v, spark, sf):
    return S.usable(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding", 64).select("id")


def _edges(spark, sf, above: float = ABOVE) -> DataFrame:
    return S.edges(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding", 64, above)


def _sims(above: float) -> tuple[str, str]:
    return "edges", f"SELECT a.vec_id AS src, b.vec_id AS dst, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > {above}"


_REACH = ("reach", "SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges")
_WALK = ("walk", "SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT b, c FROM walk JOIN reach ON a = id")
_LABELLED = ("clusters", "SELECT id, min(c) AS component FROM walk GROUP BY 1")
_GRAPH = (_sims(ABOVE), _REACH, _WALK, _LABELLED)


@query(with_views("SELECT src, dst, round(sim, 6) AS sim FROM edges", _sims(0.2)))
def cosine_pairs(v, spark, sf):
    return _edges(spark, sf, 0.2).select("src", "dst", F.round("sim", 6).alias("sim"))


@query(with_views("SELECT src, dst, round(sim, 6) AS sim FROM edges", _sims(ABOVE)))
def similarity_edges(v, spark, sf):
    return _edges(spark, sf).select("src", "dst", F.round("sim", 6).alias("sim"))


@query(with_views("SELECT least(src // 5, dst // 5) AS src, greatest(src // 5, dst // 5) AS dst, round(max(sim), 6) AS sim FROM edges WHERE src // 5 <> dst // 5 GROUP BY 1, 2", _sims(0.2)))
def sentence_max_similarity(v, spark, sf):
    """Five vectors in a row stand for the sentences of one description."""
    parts = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.expr("vec_id div 5").alias("owner"), "embedding")
    return S.best_of_parts(parts, "embedding", 64, 0.2).select("src", "dst", F.round("sim", 6).alias("sim"))


def _clusters(spark, sf) -> DataFrame:
    return L.clustered(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding", 64, ABOVE)


@query(with_views("SELECT * FROM clusters", *_GRAPH))
def connected_components(v, spark, sf):
    return _clusters(spark, sf)


@query(with_views("SELECT component, count(*) AS size FROM clusters GROUP BY 1 HAVING count(*) >= 5", *_GRAPH))
def cluster_sizes(v, spark, sf):
    return C.sizes(_clusters(spark, sf), 5)


@query(with_views("SELECT component, size, id FROM (SELECT *, count(*) OVER (PARTITION BY component) AS size FROM clusters) WHERE size >= 5", *_GRAPH))
def cluster_members(v, spark, sf):
    return C.members(_clusters(spark, sf), 5)


_TERMS = ("terms", "SELECT issue_id AS id, lower(trim(l)) AS term FROM (SELECT issue_id, unnest(string_split_regex(labels, '[;,]')) AS l FROM issues) WHERE trim(l) <> '' UNION ALL SELECT issue_id, component FROM issues JOIN issue_component USING (issue_key)")
_LARGE = ("large", "SELECT component, count(*) AS size FROM clusters GROUP BY 1 HAVING count(*) >= 5")
_TOPTERMS = ("topterms", "SELECT c.component, term, count(*) AS n, row_number() OVER (PARTITION BY c.component ORDER BY count(*) DESC, term)::INT AS rank FROM clusters c JOIN large USING (component) JOIN terms USING (id) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY c.component ORDER BY count(*) DESC, term) <= 5")
_LABELS = ("named", "SELECT component, size, coalesce(min_by(class_id, rank), 12)::INT AS class_id FROM large LEFT JOIN (SELECT t.component, t.rank, k.class_id FROM topterms t JOIN component_class k ON k.component = t.term) USING (component) GROUP BY 1, 2")
_TRUTH = ("truths", "SELECT issue_key, min(class_id)::INT AS truth FROM issue_component JOIN component_class USING (component) GROUP BY 1")
_PAIRS = ("pairs", "SELECT i.issue_key, truth, n.class_id AS prediction FROM clusters c JOIN named n USING (component) JOIN issues i ON i.issue_id = c.id JOIN truths USING (issue_key)")


def _terms(v) -> DataFrame:
    names = v["issues"].select(F.col("issue_id").alias("id"), F.explode(X.label_names(F.col("labels"))).alias("term")).withColumn("term", F.lower("term"))
    parts = v["issues"].join(v["issue_component"], "issue_key").select(F.col("issue_id").alias("id"), F.col("component").alias("term"))
    return names.unionByName(parts)


def _pairs(v, spark, sf) -> DataFrame:
    found = _clusters(spark, sf)
    return L.aligned(found, L.labelled(found, _terms(v), v["component_class"]), v["issues"], v["issue_component"], v["component_class"])


@query(with_views("SELECT * FROM topterms", *_GRAPH, _TERMS, _LARGE, _TOPTERMS))
def cluster_topk_terms(v, spark, sf):
    return C.top_terms(_clusters(spark, sf), _terms(v))


@query(with_views("SELECT * FROM named", *_GRAPH, _TERMS, _LARGE, _TOPTERMS, _LABELS))
def cluster_label(v, spark, sf):
    return L.labelled(_clusters(spark, sf), _terms(v), v["component_class"])


@query(with_views("SELECT * FROM truths", _TRUTH))
def truth_min_class(v, spark, sf):
    return C.truth(v["issue_component"], v["component_class"])


@query(with_views("SELECT * FROM pairs", *_GRAPH, _TERMS, _LARGE, _TOPTERMS, _LABELS, _TRUTH, _PAIRS))
def truth_prediction_join(v, spark, sf):
    return _pairs(v, spark, sf)


_NMI = """SELECT round(CASE WHEN ha + hb < 1e-15 THEN 1.0 WHEN abs(mi) < 1e-15 THEN 0.0 ELSE 2 * mi / (ha + hb) END, 9) AS nmi FROM
 (SELECT sum(n / t * ln(t * n / (na * nb))) AS mi FROM (SELECT n::DOUBLE AS n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY truth) AS na, sum(n) OVER (PARTITION BY prediction) AS nb FROM (SELECT truth, prediction, count(*) AS n FROM pairs GROUP BY 1, 2))),
 (SELECT -sum(n / t * ln(n / t)) AS ha FROM (SELECT count(*)::DOUBLE AS n, sum(count(*)) OVER () AS t FROM pairs GROUP BY truth)),
 (SELECT -sum(n / t * ln(n / t)) AS hb FROM (SELECT count(*)::DOUBLE AS n, sum(count(*)) OVER () AS t FROM pairs GROUP BY prediction))"""


@query(with_views(_NMI, *_GRAPH, _TERMS, _LARGE, _TOPTERMS, _LABELS, _TRUTH, _PAIRS))
def nmi(v, spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    return L.agreement(vectors, "vec_id", "embedding", 64, ABOVE, _terms(v), v["issues"], v["issue_component"], v["component_class"]).select(F.round("nmi", 9).alias("nmi"))


@query(with_views("SELECT size, component, issue_id, issue_key || '     ' || summary AS line FROM (SELECT *, count(*) OVER (PARTITION BY component) AS size FROM clusters) JOIN issues ON issue_id = id", *_GRAPH))
def cluster_listing(v, spark, sf):
    return I.cluster_listing(_clusters(spark, sf), v["issues"])


@query(with_views("SELECT src, dst, round(sim, 6) AS sim FROM edges", _sims(ABOVE)))
def dense_matrix(v, spark, sf):
    """The similarities as the lines of a square matrix in files, read back."""
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    n = vectors.agg(F.coalesce(F.max("vec_id") + 1, F.lit(0))).first()[0]
    path = f"{shared_dir(spark)}/matrix-{uuid.uuid4().hex}"
    write_matrix(_edges(spark, sf), n, path, compression="zstd")
    return read_matrix(spark, path, ABOVE).select("src", "dst", F.round("sim", 6).alias("sim"))


def _clustered_tokens(v, found: DataFrame) -> DataFrame:
    found = C.members(found, 5)
    return found.join(_kept(v), found.id == F.col("issue_id")).select("component", "id", F.col("t").alias("tokens"))


_CLUSTERED = ("clustered", "SELECT component, issue_id AS id, t AS tokens FROM clusters JOIN large USING (component) JOIN kept ON issue_id = clusters.id")
_TOPICS = (*_GRAPH, _LARGE, _TOKENS, _KEPT, _CLUSTERED, *M.topics("clustered", 2, T.PASSES, T.SWEEPS, 5, 1, T.SPREAD))


@query(with_views("SELECT component, topic, rank, term, round(weight, 6) AS weight FROM topics", *_TOPICS, once=True))
def lda_topics(v, spark, sf):
    return T.topics_of_clusters(_clustered_tokens(v, _clusters(spark, sf))).select("component", "topic", "rank", "term", F.round("weight", 6).alias("weight"))


@query(with_views("SELECT component, size, coalesce(min_by(class_id, rank), 12)::INT AS class_id FROM large LEFT JOIN (SELECT t.component, t.rank, k.class_id FROM topics t JOIN component_class k ON k.component = t.term WHERE topic = 0) USING (component) GROUP BY 1, 2", *_TOPICS, once=True))
def cluster_topic_label(v, spark, sf):
    found = _clusters(spark, sf)
    return L.labelled_by_topic(found, _clustered_tokens(v, found), v["component_class"])


# From text to vectors, clusters and their score ------------------------------------------------------------------------

TEXT_ABOVE = 0.95
_TEXTS = ("texts", "SELECT issue_id AS id, t AS tokens FROM kept")
_WORDS = ("words", "SELECT DISTINCT unnest(tokens) AS word FROM texts")
_VECTORS = (*M.context_vectors("texts", V.WINDOW, V.LEAST, V.DIM), *M.all_vectors("words", V.DIM, V.BUCKETS, V.SHORTEST, V.LONGEST))


@query(with_views("SELECT word, known, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 4) AS length, round(list_sum(v), 4) + 0.0 AS total FROM all_vectors", _TOKENS, _KEPT, _TEXTS, _WORDS, *_VECTORS, once=True))
def word_vectors(v, spark, sf):
    """Every word's vector, by its neighbours or, for a rare one, by its parts; as its length and the sum of its numbers."""
    docs = stored(_kept(v).select(F.col("issue_id").alias("id"), F.col("t").alias("tokens")), "texts")
    vectors = stored(V.context_vectors(docs), "word-vectors")
    found = V.vectors_of(docs.select(F.explode_outer("tokens").alias("word")), vectors, V.subword_buckets(vectors))
    length, total = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return found.select("word", "known", F.round(length, 4).alias("length"), (F.round(total, 4) + F.lit(0.0)).alias("total"))


_DIGITS = ", ".join(f"avg(instr('0123456789abcdef', substr(h, {i + 1}, 1)) - 8.5)" for i in range(V.DIM))


@query(with_views(f"SELECT id, round(list_sum(v), 6) + 0.0 AS total, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS length FROM (SELECT id, [{_DIGITS}] AS v FROM (SELECT id, md5(unnest(tokens)) AS h FROM texts) GROUP BY 1)", _TOKENS, _KEPT, _TEXTS, once=True))
def encoded_texts(v, spark, sf):
    """Texts through the slot for sentence encoders; as the sum and the length of their vectors."""
    found = _kept(v).select(F.col("issue_id").alias("id"), E.encoded(F.col("t"), E.digest_encoder).alias("v")).where("v IS NOT NULL")
    length, total = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return found.select("id", (F.round(total, 6) + F.lit(0.0)).alias("total"), F.round(length, 6).alias("length"))


_RAW = ("texts", f"""SELECT issue_id AS id, list_filter(list_transform(regexp_extract_all(coalesce(cleaned, ''), '{_TOKEN}'), lambda x: lower(x)), lambda x: NOT x IN {_STOP} AND NOT regexp_matches(x, '{X.NUMBER}')) AS tokens FROM issues LEFT JOIN cleaned USING (issue_id)""")
_FROM_TEXT = (
    *_cleaned("summary"), _RAW, _WORDS, *_VECTORS, ("text_means", M.mean_vectors("texts", V.DIM)),
    ("edges", f"SELECT a.id AS src, b.id AS dst FROM text_means a JOIN text_means b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) > {TEXT_ABOVE}"),
    _REACH, ("walk", "SELECT issue_id AS id, issue_id AS c FROM issues UNION SELECT b, c FROM walk JOIN reach ON a = id"), _LABELLED, _LARGE,
)
_TEXT_TOPICS = (("clustered", "SELECT component, c.id, tokens FROM clusters c JOIN large USING (component) JOIN texts t ON t.id = c.id"), *M.topics("clustered", 2, T.PASSES, T.SWEEPS, 5, 1, T.SPREAD))
_TEXT_LABELS = ("named", "SELECT component, size, coalesce(min_by(class_id, rank), 12)::INT AS class_id FROM large LEFT JOIN (SELECT t.component, t.rank, k.class_id FROM topics t JOIN component_class k ON k.component = t.term WHERE topic = 0) USING (component) GROUP BY 1, 2")


@query(with_views("SELECT * FROM clusters", *_FROM_TEXT, once=True))
def text_clusters(v, spark, sf):
    return L.clusters_from_text(v["issues"], STOP_WORDS, TEXT_ABOVE, compat=True)[0]


@query(with_views(_NMI, *_FROM_TEXT, *_TEXT_TOPICS, _TEXT_LABELS, _TRUTH, _PAIRS, once=True))
def text_agreement(v, spark, sf):
    """The whole chain from raw text to the score, without stand-ins."""
    return L.agreement_from_text(v["issues"], v["issue_component"], v["component_class"], STOP_WORDS, TEXT_ABOVE, compat=True).select(F.round("nmi", 9).alias("nmi"))


SENTENCE_ABOVE = 0.97
_PARTS = (
    *_SENTENCES,
    ("texts", f"SELECT row_number() OVER (ORDER BY id, sentence) AS id, id AS owner, list_filter(list_transform(regexp_extract_all(text, '{_TOKEN}'), lambda x: lower(x)), lambda x: NOT x IN {_STOP} AND NOT regexp_matches(x, '{X.NUMBER}')) AS tokens FROM sentences"),
    _WORDS, *_VECTORS, ("text_means", M.mean_vectors("texts", V.DIM)), ("parts", f"SELECT DISTINCT owner, v::DOUBLE[{V.DIM}] AS v FROM text_means JOIN texts USING (id)"),
)


@query(with_views(f"SELECT a.owner AS src, b.owner AS dst, round(max(array_cosine_similarity(a.v, b.v)), 6) AS sim FROM parts a JOIN parts b ON a.owner < b.owner WHERE array_cosine_similarity(a.v, b.v) > {SENTENCE_ABOVE} GROUP BY 1, 2", *_PARTS, once=True))
def description_similarity(v, spark, sf):
    """The best pair of sentences of every two documents."""
    return L.description_similarity(v["issues"], STOP_WORDS, SENTENCE_ABOVE, text="summary").select("src", "dst", F.round("sim", 6).alias("sim"))
