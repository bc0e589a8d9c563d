"""DuckDB SQL for the operators on shingles and windows, straight from their definitions."""

from __future__ import annotations

_WORDS = "words AS (SELECT doc_id, list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents)"
_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def jaccard(n: int = 3, percent: int = 90) -> str:
    gram = " || ' ' || ".join(f"w[i + {j}]" for j in range(n))
    return f"""
WITH RECURSIVE {_WORDS.format(text=_FOLDED)},
grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {n} + 2), lambda i: {gram}) END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
walk AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT b, c FROM walk JOIN edges ON a = id)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(c) AS component_id FROM (SELECT id AS doc_id, c FROM walk) LEFT JOIN sizes USING (doc_id) GROUP BY doc_id"""


def _windows(k: int) -> str:
    return f"""{_WORDS.format(text="coalesce(text, '')")},
each AS (SELECT doc_id, w[i] AS word, i, len(w) AS n, CASE WHEN i + {k - 1} <= len(w) THEN md5(array_to_string(w[i:i + {k - 1}], ' ')) END AS h FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM words))"""


def passages(k: int = 50) -> str:
    return f"""
WITH {_windows(k)},
marked AS (SELECT *, h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 AS again FROM each),
covered AS (SELECT *, max(again::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS c FROM marked)
SELECT doc_id, any_value(n)::BIGINT AS n_words, sum(c)::BIGINT AS n_repeated FROM covered GROUP BY 1 HAVING sum(c) > 0"""


def dedup(k: int = 20) -> str:
    return f"""
WITH {_windows(k)},
marked AS (SELECT *, h IS NOT NULL AND row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AS again FROM each),
covered AS (SELECT *, max(again::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS c FROM marked),
kept AS (SELECT doc_id, any_value(n) AS n, sum(c) AS gone, string_agg(word, ' ' ORDER BY i) FILTER (c = 0) AS t FROM covered GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM documents d LEFT JOIN kept USING (doc_id)"""


def held_out(key: str = "doc_id") -> str:
    """crc32 of the key as text, modulo 3, is 1."""
    bits = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)) + y)"
    # Byte by byte: the low byte of the remainder goes through the bits, the rest is shifted.
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({key}::VARCHAR, ''), lambda z: ascii(z)::BIGINT)), lambda c, b: {bits}), 4294967295) % 3 = 1"


def cross_entropy(pair_mass: float, word_mass: float, words: int) -> str:
    """Losses under both bigram models, from whole words."""

    def loss(of: str, scale: str) -> str:
        one = f"((w.{of} * {scale} + {word_mass} / {words}) / (good + {word_mass}))"
        return f"avg(-ln(CASE WHEN e.prev IS NULL THEN {one} ELSE (p.{of} * {scale} + {pair_mass} * {one}) / (v.{of} * {scale} + {pair_mass}) END))"

    return f"""
WITH {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")},
target AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL AND NOT {held_out()}),
each AS (SELECT doc_id, w[i] AS word, CASE WHEN i > 1 THEN w[i - 1] END AS prev, doc_id IN (SELECT doc_id FROM target) AS t FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM words)),
n AS (SELECT count(*)::DOUBLE AS every, count(*) FILTER (t)::DOUBLE AS good FROM each),
w AS (SELECT word, count(*) AS n_all, count(*) FILTER (t) AS n_good FROM each GROUP BY 1),
p AS (SELECT prev, word, count(*) AS n_all, count(*) FILTER (t) AS n_good FROM each WHERE prev IS NOT NULL GROUP BY 1, 2),
losses AS (SELECT e.doc_id, {loss("n_good", "1")} AS a, {loss("n_all", "good / every")} AS b FROM each e CROSS JOIN n JOIN w ON w.word = e.word LEFT JOIN w v ON v.word = e.prev LEFT JOIN p ON p.prev = e.prev AND p.word = e.word GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_tokens, round(a, 6) + 0.0 AS target_loss, round(b, 6) + 0.0 AS background_loss, round(a - b, 6) + 0.0 AS loss_difference FROM words LEFT JOIN losses USING (doc_id)"""


def minimax(k: int = 16) -> str:
    """The cuts by binary search over the capacity, each try by greedy jumps over the sums of all groups."""
    bits = "list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)) + y)"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda z: ('0x' || z)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"
    runs = "len(list_filter(list_zip(list_concat([0], list_sort(alone)), list_concat(list_sort(alone), [groups + 1])), lambda x: x[2] - x[1] > 1))"
    # The groups from p on that one shard holds: up to the next group that stands alone, and to the capacity.
    end = "least(coalesce(list_min(list_filter(alone, lambda x: x > p)) - 1, groups), len(list_filter(c, lambda x: x <= cap + CASE WHEN p > 1 THEN c[p - 1] ELSE 0 END)))"
    skip = "CASE WHEN list_contains(alone, p) THEN p + 1 ELSE {0} + 1 END"
    return f"""
WITH RECURSIVE crcs AS (SELECT list({bits} ORDER BY i) AS t FROM (SELECT i::BIGINT AS i FROM range(256) r(i))),
rows_ AS (SELECT doc_id, text, coalesce(strlen(text), 0) + 1 AS size, {crc} AS text_crc32 FROM documents, crcs),
texts AS (SELECT text, coalesce(min(doc_id), -1) AS key, sum(size) AS bytes FROM rows_ GROUP BY text),
groups_ AS (SELECT key, sum(bytes)::BIGINT AS s, row_number() OVER (ORDER BY key) AS i, (sum(sum(bytes)) OVER (ORDER BY key))::BIGINT AS c FROM texts GROUP BY key),
lists AS (SELECT list(s ORDER BY i) AS s, list(c ORDER BY i) AS c, list(key ORDER BY i) AS keys, list(i ORDER BY s DESC, i) AS largest, count(*) AS groups, max(c) AS total FROM groups_),
huge AS (SELECT []::BIGINT[] AS alone, 0 AS n, total AS rest, false AS done FROM lists UNION ALL
 SELECT CASE WHEN more THEN list_append(alone, largest[n + 1]) ELSE alone END, n + more::INT, rest - CASE WHEN more THEN s[largest[n + 1]] ELSE 0 END, NOT more
 FROM (SELECT h.*, l.*, n < {k} AND n < groups AND s[largest[n + 1]] * ({k} - n) > rest AS more FROM huge h, lists l WHERE NOT done)),
apart AS (SELECT CASE WHEN bool_or({runs} > {k} - n) THEN []::BIGINT[] ELSE max_by(alone, n) END AS alone FROM huge, lists),
given AS (SELECT l.*, alone, {k} - len(alone) AS left_, list_max(list_transform(range(1, groups + 1), lambda i: CASE WHEN list_contains(alone, i) THEN 0 ELSE l.s[i] END)) AS most,
 total - coalesce(list_sum(list_transform(alone, lambda i: l.s[i])), 0) AS rest FROM lists l, apart),
search AS (SELECT greatest(most, ceil(rest / greatest(left_, 1)))::BIGINT AS low, total AS high, (greatest(most, ceil(rest / greatest(left_, 1)))::BIGINT + total) // 2 AS cap, 1::BIGINT AS p, 0 AS used FROM given UNION ALL
 SELECT lo, hi, CASE WHEN ended THEN (lo + hi) // 2 ELSE cap END, CASE WHEN ended THEN 1 ELSE next END, CASE WHEN ended THEN 0 ELSE shards END FROM (
  SELECT *, CASE WHEN ended AND NOT fits THEN cap + 1 ELSE low END AS lo, CASE WHEN ended AND fits THEN cap ELSE high END AS hi FROM (
   SELECT *, shards > left_ OR next > groups AS ended, shards <= left_ AS fits FROM (
    SELECT search.*, given.left_, given.groups, {skip.format(end)} AS next, used + (NOT list_contains(alone, p))::INT AS shards FROM search, given WHERE low < high)))),
best AS (SELECT min(low) AS cap FROM search WHERE low = high),
starts AS (SELECT 1::BIGINT AS p FROM given WHERE groups > 0 UNION ALL SELECT {skip.format(end)} FROM starts, given, best WHERE p <= groups),
cuts AS (SELECT p, row_number() OVER (ORDER BY p) AS j FROM (SELECT p FROM starts, given WHERE p > 1 AND p <= groups)),
ends AS (SELECT j, least(coalesce(p, groups), groups - least(groups, {k}) + 1 + j) AS p FROM (SELECT unnest(range(1, least(groups, {k}))) AS j, groups FROM given) LEFT JOIN cuts USING (j)),
placed AS (SELECT doc_id, size, text_crc32, key, (SELECT count(*) FROM ends WHERE ends.p <= g.i)::INT AS shard FROM rows_ r JOIN texts x ON x.text IS NOT DISTINCT FROM r.text JOIN groups_ g USING (key))
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY key, doc_id) - 1 AS slot, NULL::INT AS grown_shard FROM placed"""
