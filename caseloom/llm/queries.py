"""The registered queries opN_<name>: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caseloom.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caseloom.llm.tokens import token_output

    return token_output(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caseloom.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caseloom.llm.language import language

    return language(table(spark, sf_dir, "documents"))


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caseloom.llm.suffix import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caseloom.llm.neighbours import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caseloom.llm.jaccard import components

    return components(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caseloom.llm.pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caseloom.llm.decontaminate import contained_items

    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caseloom.llm.mixture import mixture

    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caseloom.llm.spans import sentence_span_dedup

    return sentence_span_dedup(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caseloom.llm.tries import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caseloom.llm.pages import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caseloom.llm.codes import vector_codes

    return vector_codes(table(spark, sf_dir, "embeddings")).drop("label")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"


def _shingles(table: str, key: str) -> str:
    """(key, s): distinct five-word shingles; all words of a shorter text as one."""
    runs = "CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"
    return f"SELECT DISTINCT {key}, unnest({runs}) AS s FROM (SELECT {key}, {_WORDS} AS w FROM {table})"


#: Smallest id reached by links; ``link`` has each pair both ways.
_REACH = "reach(id, root) AS (SELECT u, v FROM link UNION SELECT r.id, k.v FROM reach r JOIN link k ON k.u = r.root)"

_OP5 = f"""WITH RECURSIVE unit AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
link AS (SELECT a.vec_id AS u, b.vec_id AS v FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
{_REACH}, low AS (SELECT id, min(root) AS root FROM reach GROUP BY id), n AS (SELECT u, count(*) AS n FROM link GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(root, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(root, vec_id)) AS kept
FROM unit LEFT JOIN low ON id = vec_id LEFT JOIN n ON u = vec_id"""

_OP6 = f"""WITH RECURSIVE sh AS ({_shingles("documents", "doc_id")}), size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT u, v FROM both_ JOIN size x ON x.doc_id = u JOIN size y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
{_REACH}, low AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(root, d.doc_id)) AS component_id FROM documents d LEFT JOIN size USING (doc_id) LEFT JOIN low ON id = d.doc_id"""

# items of fewer than five words are looked for as runs of their own length
_OP8 = f"""WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents), iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
k AS (SELECT DISTINCT least(len(w), 5) AS k FROM iw WHERE len(w) > 0),
d AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM dw, k WHERE len(w) >= k),
i AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM iw, k WHERE k = least(len(w), 5)),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n) AS n_item, count(*) / CAST(any_value(n) AS DOUBLE) AS containment
FROM d JOIN i USING (k, s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING 100 * count(*) >= 75 * any_value(n)"""

# a sentence and the white space after it: up to a stop before white space, a line end, or the end
_SENTENCE = r"(?s)(?:[.!?][\x20\x09-\x0D]+|[^\x20\x09-\x0D].*?(?:[.!?][\x20\x09-\x0D]+|[\x20\x09\x0B-\x0D]*\n[\x20\x09-\x0D]*|[\x20\x09-\x0D]*$))"
_OP10 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT r, doc_id, t, unnest(g) AS seg, unnest(range(0, len(g))) AS i FROM (SELECT *, regexp_extract_all(t, '{_SENTENCE}') AS g FROM d)),
k AS (SELECT *, array_to_string(regexp_extract_all(translate(seg, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), ' ') AS k FROM s),
c AS (SELECT *, sum(w) OVER (PARTITION BY r ORDER BY i) AS z FROM (SELECT *, len(string_split(k, ' ')) AS w FROM k)),
e AS (SELECT x.r, x.i, min(y.i) AS j FROM c x JOIN c y ON y.r = x.r AND y.i > x.i AND y.i < x.i + 15 AND y.z - x.z + x.w >= 15 GROUP BY x.r, x.i),
run AS (SELECT e.r, e.i, e.j, any_value(c.doc_id) AS doc_id, any_value(c.t) AS t, string_agg(c.k, chr(10) ORDER BY c.i) AS name FROM e JOIN c ON c.r = e.r AND c.i BETWEEN e.i AND e.j GROUP BY e.r, e.i, e.j),
again AS (SELECT r, i, j, row_number() OVER (PARTITION BY name ORDER BY doc_id NULLS FIRST, t, r, i) AS n FROM run),
gone AS (SELECT DISTINCT r, unnest(range(i, j + 1)) AS i, 1 AS gone FROM again WHERE n > 1),
o AS (SELECT r, count(*) AS n, count(gone) AS g, coalesce(sum(octet_length(encode(seg))) FILTER (WHERE gone = 1), 0) AS b, coalesce(string_agg(seg, '' ORDER BY i) FILTER (WHERE gone IS NULL), '') AS kept FROM s LEFT JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_sentences, coalesce(g, 0) AS n_removed, CAST(coalesce(b, 0) AS BIGINT) AS bytes_removed, regexp_extract(t, '^[\\x20\\x09-\\x0D]*') || coalesce(kept, '') AS text FROM d LEFT JOIN o USING (r)"""

# crc32 bit by bit: a byte goes in, then eight shifts (-1)
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, len(s) + 1), lambda i: [ascii(s[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295)"""

_OP11 = f"""WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, r, sha256(concat(octet_length(encode(r)), ':', r, x))) AS s FROM t GROUP BY c),
h AS (SELECT c, {_CRC} % 9 AS h FROM (SELECT c, CAST(c AS VARCHAR) AS s FROM own)),
seq AS (SELECT a.c, list_concat(coalesce(b.s[1:h], []), a.s[h + 1:]) AS s FROM own a JOIN h ON h.c = a.c LEFT JOIN own b ON b.c = a.c - a.c % 5),
pre AS (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM seq),
node AS (SELECT d, s[1:d] AS p, min(c) AS c, count(*) AS n, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE len(s) = d), '')) AS ends FROM pre GROUP BY ALL),
kid AS (SELECT p[1:d - 1] AS p, count(*) AS k FROM node WHERE d > 0 GROUP BY ALL),
own_ AS (SELECT node.*, coalesce(k, 0) AS k, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * octet_length(encode(p[d].x)) END AS saved FROM node LEFT JOIN kid USING (p)),
sub AS (SELECT p[1:i] AS p, count(*) FILTER (WHERE k = 0) AS leaves, CAST(sum(saved) AS BIGINT) AS saved FROM (SELECT p, k, saved, unnest(range(0, d + 1)) AS i FROM own_) GROUP BY ALL)
SELECT a.c AS conv_id, a.d AS depth, b.c AS parent_conv_id, a.n AS n_convs, a.k AS n_children, sub.leaves AS n_leaves, sub.saved AS saved_tokens, a.ends AS ends_sha256
FROM own_ a JOIN sub ON sub.p = a.p LEFT JOIN node b ON a.d > 0 AND b.p = a.p[1:a.d - 1]"""


def _lloyd(k: int) -> str:
    """Assignment a{k} of parts to codebook c{k}, and the codebook after it."""
    gap = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - y[i]) * (x[i] - y[i])))"
    return f"""a{k} AS (SELECT r, part, x, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM (SELECT r, part, x, e, coalesce({gap}, 0) AS d FROM p JOIN c{k} USING (part)) GROUP BY r, part, x),
m{k} AS (SELECT part, e, i, floor(sum(x[i]) / count(*)) AS v FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM a{k}) GROUP BY part, e, i),
c{k + 1} AS (SELECT c.part, c.e, coalesce(any_value(n.y), c.y) AS y FROM c{k} c LEFT JOIN (SELECT part, e, list(CAST(v AS BIGINT) ORDER BY i) AS y FROM m{k} GROUP BY part, e) n USING (part, e) GROUP BY c.part, c.e, c.y)"""


_OP13 = f"""WITH q AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
p AS (SELECT r, part, v[part * w + 1:(part + 1) * w] AS x FROM (SELECT r, v, len(v) // 16 AS w, unnest(range(0, 16)) AS part FROM q)),
c0 AS (SELECT part, e, x AS y FROM p JOIN (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM q QUALIFY e < 64) USING (r)),
{_lloyd(0)}, {_lloyd(1)}, {_lloyd(2)},
s AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, e)) AS h FROM c2),
w AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM q JOIN w USING (r), s"""


def oracle_sql() -> dict[str, str]:
    """Ops 1 to 4, 7, 9 and 12 have no SQL: tokenizers, learned models, byte windows of whole corpora and seeded choices are tested by brute force."""
    return {"op5_neighbours": _OP5, "op6_jaccard": _OP6, "op8_decontaminate": _OP8, "op10_sentence_spans": _OP10, "op11_conversation_trie": _OP11, "op13_vector_codes": _OP13}


__all__ = ["oracle_sql", "queries"]
