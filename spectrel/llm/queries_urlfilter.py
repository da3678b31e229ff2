from spectrel.llm import common, urlfilter


def op10_url_filter(spark, sf_dir):
    return urlfilter.judge(common.table(spark, sf_dir, "pages", "page_id", "url")).drop("url")
