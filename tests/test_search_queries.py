"""Which rows the searches ask for."""

from pricelake.plans import search_queries as Q


def test_every_hundredth_part_asks(spark, sf_dir):
    asked = Q._queries(spark, sf_dir)
    want = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 100 = 0")
    assert sorted(r[0] for r in asked.select("query_id").collect()) == sorted(r[0] for r in want.select("p_partkey").collect())
    assert asked.where("market IS NULL OR query = ''").count() == 0


def test_report_lists_the_stores_of_a_market_once(spark, sf_dir, monkeypatch):
    """Lists of blocked and failed shops are made of a row a shop, however many queries share them; they are those of each query's market."""
    rows, plain = [], Q.P.attempted
    monkeypatch.setattr(Q.P, "attempted", lambda attempts, key: rows.append(attempts.count()) or plain(attempts, key))
    got = {r["query_id"]: (r["blocked"], r["errored"]) for r in Q.idn_2_report(spark, sf_dir).collect()}
    newest = {}
    for r in spark.read.parquet(f"{sf_dir}/events.parquet").collect():
        newest[r["user_id"]] = max(newest.get(r["user_id"], (r["ts"], "")), (r["ts"], r["event_type"]))
    shops = {s["retailer"]: s["market"] for s in Q._markets(spark, sf_dir).collect()}
    ends = {f"store{user}": kind for user, (_, kind) in newest.items() if f"store{user}" in shops}
    assert rows == [len(ends)]
    listed = lambda market, kind: ",".join(sorted(s for s, end in ends.items() if end == kind and shops[s] == market))
    for q in Q._queries(spark, sf_dir).collect():
        if any(shops[s] == q["market"] for s in ends):
            assert got[q["query_id"]] == (listed(q["market"], "signup"), listed(q["market"], "error"))
