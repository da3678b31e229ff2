from spectrel.llm import collocations, common


def op13_collocations(spark, sf_dir):
    return collocations.mine(common.table(spark, sf_dir, "documents", "lang", "text"))


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM d),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM i, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100),
c AS (SELECT * FROM f WHERE k > 1),
kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c AS o WHERE o.lang = c.lang AND o.k > c.k AND 100 * o.a >= 100 * c.a AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (SELECT lang, phrase, a, cut, array_to_string(string_split(phrase, ' ')[:cut], ' ') AS lp, array_to_string(string_split(phrase, ' ')[cut + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)),
s AS (SELECT cuts.lang, cuts.phrase, cuts.a, cut, x.a AS l, y.a AS r, t.n, CAST((1000::HUGEINT * cuts.a * t.n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.phrase = lp JOIN f AS y ON y.lang = cuts.lang AND y.phrase = rp JOIN t ON t.lang = cuts.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
