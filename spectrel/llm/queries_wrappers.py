from pyspark.sql import functions as F

from spectrel.llm import common, wrappers


def op12_html_extraction(spark, sf_dir):
    found = wrappers.extract(common.table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: The tables' pages have their main text in one article of headings and paragraphs, and four character references.
SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS t FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(t, '</?(?:h1|p)>'), lambda x: replace(replace(replace(replace(replace(replace(
  trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&amp'), '&amp', '&')) AS blocks FROM a),
c AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM c
"""
