"""Provider files: arrays, envelopes, lines, and files that are broken."""

import json

import pytest

from touchline.sources import envelopes
from touchline.sources import feeds as FD

COMPS = [{"competition_id": i, "season_id": 2000 + i, "country_name": "X", "competition_name": f"Ünited \"cup\", {i}", "competition_gender": "male",
          "competition_youth": False, "competition_international": i == 1, "season_name": str(2000 + i), "extra": {"a": [1, {}]}} for i in range(1, 8)]
LEAGUES = [{"league": {"id": i, "name": "L", "type": "League"}, "country": {"name": "C", "code": None}, "seasons": [{"year": 2020}, {"year": 2021}]} for i in range(1, 5)]


def put(folder, files):
    for name, text in files.items():
        at = folder / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    return str(folder)


def shapes(rows):
    return {"lines.json": "\n".join(map(json.dumps, rows)) + "\n\n", "array.json": json.dumps(rows), "pretty.json": json.dumps(rows, indent=2),
            "rows.json": "[\n" + ",\n".join(map(json.dumps, rows)) + "\n]\n", "crlf.json": json.dumps(rows, indent=1).replace("\n", "\r\n")}


@pytest.mark.parametrize("shape", shapes([1]))
def test_every_shape_reads_alike(spark, tmp_path, shape):
    got = FD.read_competitions(spark, put(tmp_path, {shape: shapes(COMPS)[shape]})).collect()
    assert sorted((r.competition_id, r.name, r.is_international) for r in got) == [
        (f"{c['competition_id']}:{c['season_id']}", c["competition_name"], c["competition_id"] == 1) for c in COMPS]
    assert FD.rejects(spark, str(tmp_path), "competitions").count() == 0


def page(rows, errors=(), **kw):
    return {"get": "leagues", "errors": errors, "paging": {"current": 1}, "response": rows}


def test_envelopes(spark, tmp_path):
    src = put(tmp_path, {"1.json": json.dumps(page(LEAGUES[:2]), indent=2), "deep/2.json": json.dumps(page(LEAGUES[2:3], {})),
                         "3.json": "\n".join(json.dumps(page([x])) for x in LEAGUES[3:]), "4.json": json.dumps(page([])), "5.json": json.dumps(page(None, None)),
                         "6.json": json.dumps(page(LEAGUES, {"token": "Error/Missing key."}), indent=4), "7.json": json.dumps(page([], ["rate limit"]))})
    got = FD.leagues_to_competitions(spark, src).collect()
    assert sorted(r.competition_id for r in got) == sorted(f"{x['league']['id']}:{y}" for x in LEAGUES for y in (2020, 2021))
    bad = FD.rejects(spark, src, "leagues").collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.reason) for r in bad) == [("6.json", 'errors: {"token":"Error/Missing key."}'), ("7.json", 'errors: ["rate limit"]')]


def test_broken_files_give_rejects(spark, tmp_path):
    good = json.dumps(COMPS[0])
    src = put(tmp_path, {
        "cut.json": json.dumps(COMPS, indent=2)[:-40], "text.json": "not json at all", "half.json": good + "\n{\"competition_id\": 5, \n" + json.dumps(COMPS[1]),
        "types.json": json.dumps([COMPS[2], {**COMPS[3], "season_id": "next year"}, 7, "x", None, [COMPS[4]]]), "missing.json": json.dumps([{"competition_id": 9}, {}]), "empty.json": "", "blank.json": "\n \n", "scalar.json": "5",
        "two.json": good.replace('": 1,', '": 8,') + "]\n,\n[" + good})
    got = FD.read_competitions(spark, src).collect()
    assert sorted(r.competition_id for r in got) == ["1:2001", "2:2002", "3:2003"]
    bad = {}
    for r in FD.rejects(spark, src, "competitions").collect():
        bad.setdefault(r.path.rsplit("/", 1)[1], []).append(r.reason)
        assert len(r.text or "") <= envelopes.SHOWN
    assert set(bad["cut.json"]) <= {"not JSON", "no competition_id"} and "not JSON" in bad["cut.json"]
    assert bad["text.json"] == ["not JSON"] and bad["half.json"] == ["not JSON"] and bad["scalar.json"] == ["not JSON"]
    assert bad["two.json"] == ["not JSON"] * 3
    assert sorted(bad["types.json"]) == ["not a record"] * 4 + ["wrong type"]
    assert sorted(bad["missing.json"]) == ["no competition_id", "no season_id"]
    assert not set(bad) & {"empty.json", "blank.json"}


def test_large_files_are_read_by_line(spark, tmp_path):
    src = put(tmp_path, {"a.json": json.dumps(COMPS, indent=2), "b.json": "\n".join(map(json.dumps, COMPS)) + "\n{"})
    found = envelopes.parsed(spark, src, FD.COMPETITION_SCHEMA, ("competition_id",), most_bytes=10)
    assert found.where("reason IS NULL").count() == len(COMPS) and found.where("reason = 'not JSON'").count() > 1


def test_a_file_over_many_blocks(spark, tmp_path):
    many = [{**COMPS[0], "competition_id": i} for i in range(3000)]
    src = put(tmp_path, {"a.json": json.dumps(many, indent=2)})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        assert FD.read_competitions(spark, src).select("competition_id").distinct().count() == 3000
        assert FD.rejects(spark, src, "competitions").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_squads(spark, tmp_path):
    def squad(team, *names):
        return {"team": {"id": team, "name": "x"}, "players": [{"id": team * 10 + i, "name": n, "age": 1, "number": None, "position": "Defender" if i else None} for i, n in enumerate(names)]}

    src = put(tmp_path, {"team=1/p.json": json.dumps(page([squad(9, "z"), squad(1, "a", "b")]), indent=1), "2.json": json.dumps(page([squad(8, "c"), squad(7, "d")])),
                         "3.json": json.dumps(page([])), "none.json": json.dumps(page([squad(4, "lost")]))})
    got = {(r.team_id, r.player_id, r.name, tuple(r.positions)) for r in FD.squads_to_players(spark, src).collect()}
    assert got == {("af:1", "10", "a", ()), ("af:1", "11", "b", ("Defender",)), ("af:2", "80", "c", ())}
