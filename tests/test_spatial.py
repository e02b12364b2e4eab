import itertools
import math
import random

from quire.operators import spatial
from quire.plans import registry

BOXES = "page_id long, box_id long, x long, y long, w long, h long"


def test_an_upright_run_has_one_angle_in_every_order(spark, tmp_path):
    """Five boxes whose centres have covariance 0 and spread most from top to bottom. Places repeat every 7200 keys; each page has its own order."""
    orders = [(page * 7200 + k, page, "P") for page, order in enumerate(itertools.permutations((4271, 6929, 3, 647, 6101))) for k in order]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = registry.queries()["g13_run_angle"](spark, str(tmp_path)).collect()
    assert len(got) == 120 and {(r.marks, r.angle) for r in got} == {(5, 90.0)}


def test_run_angles_are_those_of_exact_moments(spark):
    rng = random.Random(5)
    pages = [[(rng.randrange(4), rng.randrange(4), 1 + rng.randrange(2), 1 + rng.randrange(2)) for _ in range(rng.randrange(1, 7))] for _ in range(300)]
    pages.append([(10**6 + i, 10**6 - i, 3, 3) for i in range(4)])
    boxes = [(p, i, *b) for p, page in enumerate(pages) for i, b in enumerate(page)]
    rng.shuffle(boxes)
    want = {}
    for p, page in enumerate(pages):
        n, cs = len(page), [(2 * x + w, 2 * y + h) for x, y, w, h in page]
        if n >= 3:
            sx, sy = (sum(c[k] for c in cs) for k in (0, 1))
            xy, xx, yy = (n * sum(c[i] * c[j] for c in cs) - s for i, j, s in ((0, 1, sx * sy), (0, 0, sx * sx), (1, 1, sy * sy)))
            want[p] = (n, round(math.degrees(0.5 * math.atan2(2 * xy, xx - yy)), 4))
    got = {r.page_id: (r.marks, r.angle) for r in spatial.run_angles(spark.createDataFrame(boxes, BOXES)).collect()}
    assert got == want and want[300] == (4, -45.0) and {0.0, 90.0} <= {a for _, a in want.values()}


def test_odd_pages_have_run_angles(spark):
    """One place for all boxes, boxes without a place, a page without a number, and no boxes."""
    same, lost, none = [(1, i, 5, 5, 2, 2) for i in range(3)], [(2, i, None, None, 2, 2) for i in range(3)], [(None, i, i, 0, 2, 2) for i in range(3)]
    part = [(3, 0, 0, 0, 2, 2), (3, 1, 0, 9, 2, 2), (3, 2, 50, None, 2, 2)]
    got = {tuple(r) for r in spatial.run_angles(spark.createDataFrame(same + lost + none + part, BOXES)).collect()}
    assert got == {(1, 3, 0.0), (2, 3, None), (None, 3, 0.0), (3, 3, 90.0)}
    assert spatial.run_angles(spark.createDataFrame([], BOXES)).collect() == []
