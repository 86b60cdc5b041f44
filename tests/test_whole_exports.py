from collections import defaultdict

from rasterloom.plans import catalog

SF = "/root/testdata/sf0.001"


def test_full_frames_of_all_orders(spark):
    want = set()
    for o in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey").collect():
        nc, nr = -(-(o.o_custkey % 5 + 1) * 700 // 256), -(-(o.o_custkey % 3 + 1) * 500 // 200)
        want |= {(o.o_orderkey, f"{r + 1}-{q + 1}-{'ab'[c]}", ((c * 2 + 1) * nr + r) * nc + q + 1) for c in range(2) for r in range(nr) for q in range(nc)}
    got = [tuple(r) for r in catalog.queries()["s13_full_frames"](spark, SF).select("instance", "key", "frame").collect()]
    assert len(got) == len(want) and set(got) == want


def test_folder_maps_of_all_customers(spark):
    whole = defaultdict(lambda: True)
    for c in spark.read.parquet(f"{SF}/customer.parquet").collect():
        k = c.c_nationkey % 5, c.c_mktsegment
        whole[k] = whole[k] and not (c.c_custkey % 11 == 3 and (k[0] + len(k[1])) % 3 == 0)
    want = {}
    for (image, group), ok in sorted(whole.items()):
        if ok and (group == "MACHINERY" or image not in want):
            want[image] = group
    assert not all(whole.values()) and want
    assert {r.image: r.group for r in catalog.queries()["j19_complete_folder_maps"](spark, SF).collect()} == want
