import re

from conftest import SF

from tracemill.plans.registry import QUERIES
from tracemill.plans.views import view


def test_long_lines_are_cut_and_stay(spark):
    want = set()
    for r in view(spark, SF, "v_results").collect():
        hits = [(k, x) for k, x in enumerate(re.split("\r?\n", r.output), 1) if "the" in x][:20]
        want |= {(r.result_id, k, x.encode()[:512].decode(errors="ignore")) for k, x in hits}
    got = [tuple(r) for r in QUERIES["prj15_grep_cut_lines"](spark, SF).select("result_id", "line", "text").collect()]
    assert len(got) == len(want) and set(got) == want and any(len(x.encode()) > 508 for _, _, x in got)
