from chronoraster.llm import splits


def test_links_of_a_hot_vertex_and_a_hot_tile(spark, monkeypatch):
    monkeypatch.setattr(splits, "HOT_ROWS", 20)
    star = spark.createDataFrame([(0, k) for k in range(1, 200)] + [(500, 501)], "u bigint, v bigint")
    got = {r.vertex: r.label for r in splits.random_mate(star).collect()}
    assert len(got) == 202 and len({got[k] for k in range(200)}) == 1 and got[500] == got[501] != got[0]
    px = spark.createDataFrame([(k, "c", 0, 0, 1, k % 90) for k in range(300)], "pixel_id bigint, cube_name string, tile_i int, tile_j int, mask smallint, id bigint")
    assert splits.shared_tile_edges(px, "id", ["cube_name", "tile_i", "tile_j"]).count() == 89
