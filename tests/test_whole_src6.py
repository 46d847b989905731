from conftest import SF, same_rows

from tracemill.plans.registry import QUERIES, SQL


def test_all_texts_pass_through_the_reader(spark, duck):
    """As the query over some of the texts, but all."""
    same_rows(QUERIES["src6_read_all_text_files"](spark, SF), duck, SQL["src6_read_text_files"].replace("result_id % 40 = 0 AND", ""))
