"""The same queries in DuckDB SQL, formulated independently of the plans: words by splitting, pairs by joins."""

from __future__ import annotations

from . import queries as q
from .functions.similarity import Algorithm
from .plans.query_tree import And, Not, Or, Word

_the, _of, _thing, _ering, _thble, _thering, _erther, _nicht = map(Word, ("the", "of", "thing", "ering", "thble", "thering", "erther", "nicht"))
#: The queries' trees, written by hand: what the parser makes of their strings isn't taken for granted here.
TREES = {
    "the ering of": And(And(_the, _ering), _of),
    "thering or nicht or (ering and thble)": Or(Or(_thering, _nicht), And(_ering, _thble)),
    "the -ering": And(_the, Not(_ering)),
    "the -(thing or ering)": And(_the, Not(Or(_thing, _ering))),
    "thering erther or nicht": Or(And(_thering, _erther), _nicht),
    "the": _the,
    "ering": _ering,
    "the of": And(_the, _of),
    "the and of": And(_the, _of),
    "the of thing": And(And(_the, _of), _thing),
    "thing or ering": Or(_thing, _ering),
    "ering -thing": And(_ering, Not(_thing)),
    "(the or thing) and (of or ering) not thble": And(And(Or(_the, _thing), Or(_of, _ering)), Not(_thble)),
    "thering erther": And(_thering, _erther),
    "thering or erther -ering": Or(_thering, And(_erther, Not(_ering))),
}
#: What query strings are read as, likewise.
PARSED = {
    "icelk kvarn": "(icelk AND kvarn)", "icelk kvarn web server": "(((icelk AND kvarn) AND web) AND server)", "not icelk": "(NOT icelk)", "or": "or", "for me": "(for AND me)", " (  ) ": "InputEmpty",
    "icelk and kvarn or agde": "((icelk AND kvarn) OR agde)", "agde or icelk and kvarn": "(agde OR (icelk AND kvarn))", "(icelk or kvarn) and code": "((icelk OR kvarn) AND code)", "code (kvarn or icelk) ": "(code AND (kvarn OR icelk))",
    " (icelk or iselk)  (kvarn or agde)))": "((icelk OR iselk) AND (kvarn OR agde))", "icelk -(agde or kvarn)": "(icelk AND (NOT (agde OR kvarn)))", "icelk - (agde or kvarn)": "(icelk AND (NOT (agde OR kvarn)))", "not ": "NotEnoughArguments",
    "or icelk": "(or AND icelk)", "(or (icelk))": "(or AND icelk)", "icelk and not kvarn or agde": "((icelk AND (NOT kvarn)) OR agde)", "icelk or not kvarn or agde": "((icelk OR (NOT kvarn)) OR agde)",
    "agde not sync or icelk and not kvarn or agde": "(((agde AND (NOT sync)) OR (icelk AND (NOT kvarn))) OR agde)", "icelk !kvarn": "(icelk AND (NOT kvarn))", "icelk.dev": "icelkdev", "next-generation kvarn": "((next AND generation) AND kvarn)",
    "river": "river", "river bank": "(river AND bank)", "river and bank": "(river AND bank)", "river or bank": "(river OR bank)", "not river": "(NOT river)", "river -bank": "(river AND (NOT bank))", "river not bank": "(river AND (NOT bank))",
    "!river": "(NOT river)", "a b c": "((a AND b) AND c)", "a or b c": "(a OR (b AND c))", "a b or c": "((a AND b) OR c)", "(a or b) c": "((a OR b) AND c)", "a (b or c) d": "((a AND (b OR c)) AND d)",
    "a and b or c and d": "((a AND b) OR (c AND d))", "a -(b or c)": "(a AND (NOT (b OR c)))", "a not b not c": "((a AND (NOT b)) AND (NOT c))", "((a))": "a", "(a b": "(a AND b)", "a) b": "(a AND b)", "a(b)c": "((a AND b) AND c)",
    "ab.cd": "abcd", "semi-colon": "(semi AND colon)", "-": "NotEnoughArguments", "": "InputEmpty", "   ": "InputEmpty", "and": "and", "a and": "(a AND and)", "or b": "(or AND b)", "not": "not", "a or not b": "(a OR (NOT b))",
    "Ä und Ö": "((ä AND und) AND ö)", "A AND b": "(a AND b)", "android orbit notable": "((android AND orbit) AND notable)", "()": "InputEmpty", "- a": "(NOT a)", "a - b": "(a AND (NOT b))", "a  and  b": "(a AND b)", "a,b": "ab",
}


def tokens(table: str, name: str, id_sql: str = "doc_id") -> str:
    """CTEs that end in name(doc_id, word, start, is_compound)."""
    return rf"""
{name}_split AS (SELECT {id_sql} AS doc_id, text, string_split_regex(text, '[^\p{{L}}\p{{N}}]') AS w, regexp_extract_all(text, '[^\p{{L}}\p{{N}}]') AS sp FROM {table} WHERE text IS NOT NULL),
{name}_each AS (SELECT doc_id, strlen(text) AS size, unnest(w) AS word, unnest(list_append(sp, NULL)) AS sep, generate_subscripts(w, 1) AS pos FROM {name}_split),
{name}_at AS (
  SELECT *, coalesce(sum(strlen(word) + coalesce(strlen(sep), 0)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start,
         lead(word) OVER o AS next_word, lead(sep) OVER o AS next_sep
  FROM {name}_each WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
{name} AS (
  SELECT doc_id, lower(word) AS word, start, false AS is_compound, size, sep IS NULL AS at_end FROM {name}_at WHERE word <> ''
  UNION ALL
  SELECT doc_id, lower(word || next_word), start, true, size, false FROM {name}_at
  WHERE sep IN ('-', '—', '–') AND word <> '' AND next_word <> '' AND next_sep IS NOT NULL)"""


TOK = tokens("documents", "tok")
BENCH = tokens("benchmark", "bench", "item_id")
TURNS = tokens("conversations", "turns", "'turn ' || conv_id || ' ' || turn")
_FOREIGN = "áéíóúñüäößçèêàùîôûëïœâ"
_SINGLE = "ABCDEFGHIJKLMNOPQRSTUV"


def proximates(config, words) -> str:
    """CTE prox(query_word, word, proximity FLOAT)."""
    values = ", ".join(f"('{w}')" for w in words)
    t = config.threshold
    if config.algorithm is Algorithm.EXACT:
        return f"prox AS (SELECT word AS query_word, word, 1.0::FLOAT AS proximity FROM (SELECT DISTINCT word FROM tok) WHERE word IN (SELECT * FROM (VALUES {values})))"
    if config.algorithm is Algorithm.JARO:
        # each foreign letter as a capital, of which there are none, so that a letter is a byte
        similar = f"jaro_similarity(translate(word, '{_FOREIGN}', '{_SINGLE}'), translate(q, '{_FOREIGN}', '{_SINGLE}'))"
    else:
        differs = "list_sum(list_transform(range(1, greatest(length(word), length(q)) + 1), lambda i: (substring(word, i, 1) <> substring(q, i, 1))::INT))"
        similar = f"1.0::DOUBLE / (1.0::DOUBLE + ({differs})::DOUBLE / least(length(word), length(q)))"
    return f"""vocab AS (SELECT DISTINCT word FROM tok),
asked AS (
  SELECT v.word, a.q, length(v.word) - strlen(a.q) AS extra FROM vocab v JOIN (VALUES {values}) a(q)
  ON (SELECT count(*) FROM vocab) <= {config.word_count_limit} OR substring(v.word, 1, 1) = substring(a.q, 1, 1)),
similar_to AS (SELECT *, ({similar})::FLOAT AS s FROM asked),
prox AS (
  SELECT q AS query_word, word, CASE
    WHEN strlen(q) < 3 THEN CASE WHEN s > {t}::FLOAT THEN s END
    WHEN extra >= 0 AND starts_with(word, q) THEN (CASE WHEN extra = 0 THEN 1.0 ELSE 1.0::DOUBLE / (0.05::DOUBLE * extra + 0.5::DOUBLE) - 1.2::DOUBLE END)::FLOAT
    WHEN s >= {t}::FLOAT THEN s END AS proximity
  FROM similar_to)"""


PROX_OUT = "SELECT query_word, word, round(proximity::DOUBLE, 6) AS proximity FROM prox WHERE proximity IS NOT NULL"


def _docs_sql(node, exact: bool, strict: bool) -> str:
    if isinstance(node, Word):
        if exact:
            return f"(SELECT DISTINCT doc_id FROM tok WHERE word = '{node.text}')"
        return f"(SELECT DISTINCT doc_id FROM tok JOIN prox USING (word) WHERE query_word = '{node.text}' AND proximity IS NOT NULL)"
    left, right = node.left, node.right
    if isinstance(node, Or):
        return f"({_docs_sql(left, exact, strict)} UNION {_docs_sql(right, exact, strict)})"
    if isinstance(left, Not):
        left, right = right, left
    if isinstance(right, Not):
        kept = _docs_sql(left, exact, strict)
        return f"({kept} EXCEPT {_docs_sql(right.part, exact, strict)})" if strict else kept
    return f"({_docs_sql(left, exact, strict)} INTERSECT {_docs_sql(right, exact, strict)})"


def documents_sql(text: str, config, strict: bool) -> str:
    tree = TREES[text]
    exact = config.algorithm is Algorithm.EXACT
    ctes = TOK if exact else f"{TOK},\n{proximates(config, tree.words())}"
    return f"WITH {ctes}\nSELECT doc_id FROM {_docs_sql(tree, exact, strict)}"


class _Hits:
    """Builds CTEs of hits (doc_id, start, word_id, rating, occ, not_start) bottom up."""

    def __init__(self, exact: bool, distance: int | None):
        self.exact, self.distance, self.ctes, self.n, self.words = exact, distance, [], 0, 0

    def add(self, sql: str) -> str:
        self.n += 1
        name = f"h{self.n}"
        self.ctes.append(f"{name} AS ({sql})")
        return name

    def leaf(self, word: str) -> str:
        self.words += 1
        w = self.words
        found = (
            f"SELECT doc_id, word, start, 0.0::DOUBLE AS rating FROM tok WHERE word = '{word}'" if self.exact
            else f"SELECT doc_id, word, start, (proximity::DOUBLE - 1) * 4 AS rating FROM tok JOIN prox USING (word) WHERE query_word = '{word}' AND proximity IS NOT NULL"
        )
        a = self.add(f"SELECT DISTINCT * FROM ({found})")
        if self.distance is None:
            return self.add(f"SELECT doc_id, start, {w} AS word_id, rating, [{{'start': start, 'word_id': {w}}}] AS occ, NULL::INT AS not_start FROM {a}")
        b = self.add(f"SELECT *, CASE WHEN abs(start - lag(start) OVER o) <= {self.distance} THEN 0 ELSE 1 END AS new FROM {a} WINDOW o AS (PARTITION BY doc_id ORDER BY word, start)")
        c = self.add(f"SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY word, start) AS run FROM {b}")
        d = self.add(f"SELECT *, row_number() OVER o AS k, lead(start) OVER o AS second FROM {c} WINDOW o AS (PARTITION BY doc_id, run ORDER BY word, start)")
        own = f"{{'start': start, 'word_id': {w}}}"
        return self.add(
            f"SELECT doc_id, start, {w} AS word_id, rating + CASE WHEN second IS NULL THEN 0.0 ELSE 2.0 END AS rating, "
            f"CASE WHEN second IS NULL THEN [{own}] ELSE list_sort(list_distinct([{own}, {{'start': second, 'word_id': {w}}}])) END AS occ, NULL::INT AS not_start FROM {d} WHERE k = 1"
        )

    def numbered(self, hits: str) -> str:
        return self.add(f"SELECT *, row_number() OVER (ORDER BY doc_id, start, word_id, rating, occ) AS id FROM {hits}")

    def pair(self, left: str, right: str, singles: bool) -> str:
        a, b = self.numbered(left), self.numbered(right)
        both = "l.doc_id, l.start, l.word_id, l.rating, list_sort(list_distinct(list_concat(l.occ, r.occ))) AS occ, l.not_start"
        sql = (
            f"(SELECT {both} FROM {a} l JOIN {b} r ON l.doc_id = r.doc_id AND r.start >= l.start QUALIFY row_number() OVER (PARTITION BY l.id ORDER BY r.id) = 1) UNION ALL "
            f"(SELECT {both} FROM {b} r JOIN {a} l ON l.doc_id = r.doc_id AND l.start > r.start QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY l.id) = 1)"
        )
        if singles:
            own = "doc_id, start, word_id, rating, occ, not_start"
            sql += (
                f" UNION ALL (SELECT {own} FROM {a} l WHERE NOT EXISTS (SELECT 1 FROM {b} r WHERE l.doc_id = r.doc_id AND r.start >= l.start))"
                f" UNION ALL (SELECT {own} FROM {b} r WHERE NOT EXISTS (SELECT 1 FROM {a} l WHERE l.doc_id = r.doc_id AND l.start > r.start))"
            )
        return self.add(sql)

    def negate(self, left: str, right: str) -> str:
        a, b = self.numbered(left), self.numbered(right)
        near = self.add(
            f"SELECT l.id, r.start AS r_start, r.rating AS r_rating FROM {a} l JOIN {b} r ON l.doc_id = r.doc_id "
            "QUALIFY row_number() OVER (PARTITION BY l.id ORDER BY abs(r.start - l.start), r.id DESC) = 1"
        )
        d = "list_min(list_transform(occ, lambda o: abs(o.start - r_start)))"
        return self.add(
            f"SELECT doc_id, start, word_id, CASE WHEN r_start IS NULL THEN rating + 2.5 ELSE rating - (1.0::DOUBLE / (0.0001::DOUBLE * {d} + 0.025::DOUBLE) + r_rating) END AS rating, "
            f"occ, coalesce(r_start, not_start) AS not_start FROM {a} LEFT JOIN {near} USING (id)"
        )

    def build(self, node) -> str:
        if isinstance(node, Word):
            return self.leaf(node.text)
        left, right = node.left, node.right
        if isinstance(node, And) and isinstance(left, Not):
            left, right = right, left
        if isinstance(node, And) and isinstance(right, Not):
            a = self.build(left)
            return self.negate(a, self.build(right.part))
        a = self.build(left)
        return self.pair(a, self.build(right), isinstance(node, Or))

    def rated(self, hits: str) -> str:
        step = (
            "list_filter(list_transform(range(1, len(occ)), lambda i: {'distance': occ[i + 1].start - occ[i].start, 'at': i - 1, 's': occ[i].start, 'w': occ[i].word_id, "
            "'differs': occ[i].word_id <> occ[i + 1].word_id}), lambda p: p.differs)"
        )
        a = self.add(f"SELECT *, {step} AS pairs FROM {hits}")
        b = self.add(f"SELECT *, coalesce(list_sum(list_transform(pairs, lambda p: 0.5::DOUBLE / (0.001::DOUBLE * p.distance + 0.1::DOUBLE))), 0) AS more, list_sort(pairs)[1] AS nearest FROM {a}")
        swapped = "list_sort(list_distinct(list_append(list_filter(occ, lambda o: NOT (o.start = nearest.s AND o.word_id = nearest.w)), {'start': start, 'word_id': word_id})))"
        return self.add(
            f"SELECT doc_id, CASE WHEN nearest.at > 0 THEN nearest.s ELSE start END AS start, word_id, round(rating + more, 6) AS rating, "
            f"CASE WHEN nearest.at > 0 THEN {swapped} ELSE occ END AS occ, not_start FROM {b}"
        )


_HITS_OUT = "doc_id, start, word_id, rating, array_to_string(list_transform(occ, lambda o: o.start || ':' || o.word_id), ' ') AS places, coalesce(not_start, -1) AS not_start"


def hits_sql(text: str, config, distance: int | None = q.DISTANCE, k: int | None = None) -> str:
    tree = TREES[text]
    exact = config.algorithm is Algorithm.EXACT
    h = _Hits(exact, distance)
    last = h.rated(h.build(tree))
    ctes = [TOK, *([] if exact else [proximates(config, tree.words())]), *h.ctes]
    tail = f" ORDER BY rating DESC, doc_id, start, word_id LIMIT {k}" if k else ""
    return f"WITH {',\n'.join(ctes)}\nSELECT {_HITS_OUT} FROM {last}{tail}"


_POSTINGS = "(SELECT DISTINCT word, doc_id, start FROM tok)"
_SIMPLE = "(SELECT DISTINCT word, doc_id FROM tok)"
W, V = q.WORD, q.OTHER
_LOOKED_UP = "VALUES " + ", ".join(f"({d}::BIGINT)" for d in q.LOOKED_UP)
_NAMED = "named AS (SELECT 'doc ' || doc_id AS name, doc_id FROM (SELECT DISTINCT doc_id FROM labels WHERE doc_id IS NOT NULL))"
#: tok(...) of documents where those with a benchmark item's id have its text.
_NOW = "current_texts AS (SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark) UNION ALL SELECT item_id, text FROM benchmark),\n" + tokens("current_texts", "tok")
_HAS = "(SELECT DISTINCT doc_id FROM tok WHERE word = '{}')"

ORACLES = {
    "tokenize": f"WITH {TOK} SELECT doc_id, word, start, is_compound FROM tok",
    "tokenize_end_offsets": f"WITH {TOK} SELECT doc_id, word, (CASE WHEN at_end THEN size ELSE start END)::INT AS start FROM tok WHERE NOT is_compound",
    "normalize_words": f"WITH {TOK} SELECT word, count(*) AS count FROM tok GROUP BY word",
    "hyphen_compounds": f"WITH {TOK} SELECT doc_id, word, start FROM tok WHERE is_compound",
    "postings_simple": f"WITH {TOK} SELECT * FROM {_SIMPLE}",
    "postings_lossless": f"WITH {TOK} SELECT word, doc_id, count(*) AS n, string_agg(start::VARCHAR, ' ' ORDER BY start) AS positions FROM {_POSTINGS} GROUP BY word, doc_id",
    "vocabulary": f"WITH {TOK} SELECT DISTINCT word FROM tok",
    "word_count": f"WITH {TOK} SELECT count(DISTINCT word) AS words FROM tok",
    "words_starting_with": f"WITH {TOK} SELECT DISTINCT word FROM tok WHERE word LIKE 'é%'",
    "index_size": f"""WITH {TOK}, per AS (SELECT word, doc_id, count(*) AS n FROM {_POSTINGS} GROUP BY word, doc_id),
words AS (SELECT word, strlen(word) + 16 AS own, sum(8 + 8 * n + 16) AS lossless, 8 * count(*) + 16 AS simple FROM per GROUP BY word)
SELECT 'lossless' AS kind, sum(own + lossless)::BIGINT AS bytes FROM words UNION ALL SELECT 'simple', sum(own + simple)::BIGINT FROM words""",
    "contains_word": f"WITH {TOK} SELECT w AS word, d AS doc_id, EXISTS (SELECT 1 FROM tok WHERE tok.word = w AND tok.doc_id = d) AS found FROM (VALUES ('{W}'), ('{V}')) a(w), ({_LOOKED_UP}) b(d)",
    "simple_upsert": hits_sql(V, q.EXACT, None).replace(TOK, _NOW, 1),
    "simple_insert_missing": f"WITH {TOK}, {BENCH} SELECT word, doc_id FROM tok WHERE doc_id IN (SELECT item_id FROM benchmark) EXCEPT SELECT word, doc_id FROM bench",
    "force_remove": f"""WITH {TOK}, {_NAMED}, gone AS (SELECT d FROM ({_LOOKED_UP}) b(d) WHERE d IN (SELECT doc_id FROM named)),
places AS (SELECT doc_id, count(*) AS places FROM {_POSTINGS} WHERE doc_id NOT IN (SELECT d FROM gone) GROUP BY doc_id)
SELECT name, doc_id, places FROM (SELECT * FROM named WHERE doc_id NOT IN (SELECT d FROM gone)) FULL JOIN places USING (doc_id)""",
    "document_map_reads": f"""WITH {_NAMED}, asked(d) AS ({_LOOKED_UP})
SELECT 'contains' AS read, d::VARCHAR AS of, (d IN (SELECT doc_id FROM named))::VARCHAR AS found FROM asked
UNION ALL SELECT 'name', d::VARCHAR, name FROM asked LEFT JOIN named ON d = doc_id UNION ALL SELECT 'id', 'doc ' || d, doc_id::VARCHAR FROM asked LEFT JOIN named ON name = 'doc ' || d
UNION ALL SELECT 'first free', '', CASE WHEN (SELECT count(*) FROM named) = 0 THEN 0 ELSE (SELECT min(i) FROM (SELECT unnest(range(1, (SELECT max(doc_id) FROM named) + 2)) AS i) WHERE i NOT IN (SELECT doc_id FROM named)) END::VARCHAR""",
    "streaming_index": f"""WITH {TOK}, {BENCH}, toxic AS (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL), now AS (
SELECT word, doc_id, start FROM tok WHERE doc_id NOT IN (SELECT item_id FROM benchmark) AND doc_id NOT IN (SELECT * FROM toxic)
UNION SELECT word, doc_id, start FROM bench WHERE doc_id NOT IN (SELECT * FROM toxic)) SELECT doc_id, count(*) AS places FROM now GROUP BY doc_id""",
    "parse": "SELECT * FROM (VALUES " + ", ".join("('" + "', '".join(x.replace("'", "''") for x in kv) + "')" for kv in PARSED.items()) + ") v(query, tree)",
    "deduplicate": f"WITH {TOK} SELECT DISTINCT word, doc_id FROM tok",
    "word_by_document": f"WITH {TOK} SELECT doc_id, doc_id IN {_HAS.format(V)} AS has_word FROM documents",
    "docs_with_word": f"WITH {TOK} SELECT doc_id FROM {_HAS.format(W)}",
    "insert_documents": f"""WITH {TOK}, {TURNS}, now AS (SELECT word, doc_id::VARCHAR AS doc_id, start FROM tok UNION SELECT word, doc_id, start FROM turns)
SELECT word, count(DISTINCT doc_id) AS docs, count(*) AS places FROM now GROUP BY word""",
    "merge_indexes": f"WITH {TOK}, {BENCH} SELECT word, doc_id, start FROM tok UNION SELECT word, doc_id, start FROM bench",
    "merge_simple_indexes": f"WITH {TOK}, {BENCH} SELECT word, doc_id FROM tok UNION SELECT word, doc_id FROM bench",
    "remove_document": f"WITH {TOK} SELECT doc_id, count(*) AS places FROM {_POSTINGS} WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY doc_id",
    "upsert_documents": f"""WITH {TOK}, {BENCH}, now AS (SELECT word, doc_id, start FROM tok WHERE doc_id NOT IN (SELECT item_id FROM benchmark)
UNION SELECT word, doc_id, start FROM bench) SELECT doc_id, count(*) AS places FROM now GROUP BY doc_id""",
    "missing_postings": f"WITH {TOK}, {BENCH} SELECT word, doc_id FROM tok WHERE doc_id IN (SELECT item_id FROM benchmark) EXCEPT SELECT word, doc_id FROM bench",
    "apply_missing": f"""WITH {TOK}, {BENCH}, kept AS (SELECT word, doc_id FROM tok WHERE doc_id NOT IN (SELECT item_id FROM benchmark)
UNION (SELECT word, doc_id FROM tok INTERSECT SELECT word, doc_id FROM bench)) SELECT doc_id, count(*) AS words FROM kept GROUP BY doc_id""",
    "document_map": f"""WITH {_NAMED},
fresh AS (SELECT name, row_number() OVER (ORDER BY name) AS n FROM (SELECT DISTINCT url AS name FROM pages WHERE url IS NOT NULL AND url NOT IN (SELECT name FROM named))),
free AS (SELECT i, row_number() OVER (ORDER BY i) AS n FROM (SELECT unnest(range(1, (SELECT max(doc_id) FROM named) + 1 + (SELECT count(*) FROM fresh))) AS i) WHERE i NOT IN (SELECT doc_id FROM named))
SELECT name, doc_id FROM named UNION ALL SELECT name, i FROM fresh JOIN free USING (n)""",
    "expand_exact": f"WITH {TOK}, {proximates(q.EXACT, q.EXPANDED)} {PROX_OUT}",
    "expand_hamming": f"WITH {TOK}, {proximates(q.HAMMING, q.EXPANDED)} {PROX_OUT}",
    "expand_prefix": f"WITH {TOK}, {proximates(q.replace(q.HAMMING, threshold=1.0), [q.PREFIX, 'é'])} {PROX_OUT}",
    "expand_jaro": f"WITH {TOK}, {proximates(q.JARO, q.EXPANDED)} {PROX_OUT}",
    "expand_whole_vocabulary": f"WITH {TOK}, {proximates(q.replace(q.HAMMING, threshold=0.7, word_count_limit=10**9), [q.FUZZY, 'of'])} {PROX_OUT}",
    "expand_documents": f"WITH {TOK}, {proximates(q.HAMMING, [q.FUZZY])} SELECT DISTINCT query_word, doc_id, word, round(proximity::DOUBLE, 6) AS proximity FROM tok JOIN prox USING (word) WHERE proximity IS NOT NULL",
    "docs_intersect": f"WITH {TOK} SELECT doc_id FROM {_HAS.format(W)} WHERE doc_id IN {_HAS.format(V)}",
    "docs_union": f"WITH {TOK} SELECT DISTINCT doc_id FROM tok WHERE word IN ('{W}', '{V}')",
    "docs_difference": f"WITH {TOK} SELECT doc_id FROM {_HAS.format(W)} WHERE doc_id NOT IN {_HAS.format(V)}",
    "deduplicate_keeping": f"WITH {TOK} SELECT word, doc_id, start FROM {_POSTINGS} QUALIFY row_number() OVER (PARTITION BY word ORDER BY doc_id, start DESC) = 1",
    "progressive": f"""WITH {TOK}, l AS (SELECT DISTINCT doc_id, start FROM tok WHERE word = '{W}'), r AS (SELECT DISTINCT doc_id, start FROM tok WHERE word = '{V}')
SELECT doc_id, start, true AS is_left, coalesce((SELECT max(r.start) FROM r WHERE r.doc_id = l.doc_id AND r.start < l.start), -1) AS behind,
       coalesce((SELECT min(r.start) FROM r WHERE r.doc_id = l.doc_id AND r.start >= l.start), -1) AS ahead FROM l
UNION ALL
SELECT doc_id, start, false, coalesce((SELECT max(l.start) FROM l WHERE r.doc_id = l.doc_id AND l.start <= r.start), -1),
       coalesce((SELECT min(l.start) FROM l WHERE r.doc_id = l.doc_id AND l.start > r.start), -1) FROM r""",
    "hits_word": hits_sql(W, q.EXACT, None),
    "hits_word_reread": hits_sql(V, q.EXACT, None),
    "search_topk": hits_sql("the and of", q.EXACT, k=20),
    "search_topk_fuzzy": hits_sql(f"{q.FUZZY} or erther -{V}", q.HAMMING, k=20),
} | {k: documents_sql(*v) for k, v in q.DOCUMENT_QUERIES.items()} | {k: hits_sql(*v) for k, v in q.HIT_QUERIES.items()}
