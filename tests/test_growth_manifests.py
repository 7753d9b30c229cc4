"""Protection of sets is read without a row, or a list, of their representations."""


from segline import catalog
from segline.operators import manifest

SF = "/root/testdata/sf0.001"
KEYS = ["channel_id", "period_id", "as_id"]


def test_sets_equal_those_of_representations(spark):
    cp = '<ContentProtection schemeIdUri="urn:mpeg:dash:mp4protection:2011" value="cenc"/>'
    empty, bare, two, none = f"<AdaptationSet>{cp}</AdaptationSet>", f"<AdaptationSet>{cp}<Representation/></AdaptationSet>", f'<AdaptationSet>{cp}{cp}<Representation id="a"/><Representation id="b"/></AdaptationSet>', '<AdaptationSet><Representation id="c"/></AdaptationSet>'
    nested = f'<AdaptationSet>{cp}<Representation id="d" bandwidth="5"><SegmentTemplate duration="2"/></Representation><Representation bandwidth="7"/></AdaptationSet>'
    bodies = [f'<MPD><Period id="p">{empty}{two}{none}</Period><Period>{nested}{bare}</Period></MPD>', "<MPD/>", "<MPD><Period/></MPD>", None, "x"]
    docs = spark.createDataFrame([(f"c{i}", b) for i, b in enumerate(bodies)], "channel_id string, body string")
    got, want = ([sorted(map(str, manifest.explode_protection(f(docs)).collect())) for f in (manifest.explode_sets, manifest.explode_manifest)])
    assert got == want and len(got) >= 3


def test_protection_makes_no_row_of_a_representation(spark):
    for name in ("p3_protection_rows", "p4_filtered_protection"):
        text = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("posexplode(") == 3 and "SegmentTemplate:" not in text and "array<struct<_id:string,_bandwidth" not in text
