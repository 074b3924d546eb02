import textwrap

import pytest

from docloom.plans.lineage import Analyser, clauses, keys_of, routes, split_list, to_spark
from docloom.plans.mapping import Field, Mapping, MappingError, digest, fits_adapter, from_dict, load_mappings, order_columns, variables

BAND = Field(
    "band", "array-sql",
    sql="SELECT m.part AS part, count(distinct m.player_id) AS players, listagg(p.`name`, '/') AS names FROM membership m INNER JOIN player p ON p.id = m.player_id GROUP BY m.band_id, m.part",
    on_main="WHERE #{band_id} = m.band_id",
)
VENUE = Field("venue", "object-sql", sql="SELECT v.`label` AS label, v.seats AS seats FROM venue v", on_main="WHERE v.town = #{town} AND v.code = #{venue_code} ORDER BY v.opened", on_slave="WHERE v.code = #{code}")
TICKETS = Field("prices", "array-flat-sql", sql="SELECT DISTINCT t.price FROM ticket t", on_main="WHERE t.concert_no = #{no}")
MAPPING = Mapping("concert", "SELECT c.no AS id, c.`starts` AS starts, coalesce(c.subtitle, c.title) AS heading FROM concert c", fields=(BAND, VENUE, TICKETS))


def test_clauses_and_lists():
    part = clauses("SELECT a, (SELECT max(x) FROM t WHERE y) AS m, 'from' AS w FROM u GROUP BY a, b")
    assert part == {"select": "a, (SELECT max(x) FROM t WHERE y) AS m, 'from' AS w", "from": "u", "group by": "a, b"}
    assert split_list("a, f(b, c), 'd, e'") == ["a", "f(b, c)", "'d, e'"]


def test_group_concat_is_ordered():
    assert to_spark("select GROUP_CONCAT(if(a = 1, b, null)) x") == "select listagg(cast(if(a = 1, b, null) as string), ',') within group (order by cast(if(a = 1, b, null) as string)) x"


def test_fragments():
    assert variables("WHERE a.x = #{id} and #{other} = b.y") == [("a.x", "id"), ("b.y", "other")]
    assert order_columns("WHERE a = #{b} ORDER BY t.c DESC, d") == [("t.c", True), ("d", False)]
    assert keys_of(BAND) == [("m.band_id", "band_id")] and keys_of(VENUE) == [("v.town", "town"), ("v.code", "venue_code")]


def test_lineage(spark):
    q = Analyser(spark).query(MAPPING.sql)
    assert [(i.name, i.plain) for i in q.items] == [("id", True), ("starts", True), ("heading", False)]
    assert q.item("heading").columns == (("c", "subtitle"), ("c", "title")) and not q.simple
    nested = Analyser(spark).query(BAND.sql, check=False)
    assert [(t.alias, t.table) for t in nested.tables] == [("m", "membership"), ("p", "player")]
    assert nested.tables[1].pairs == ((("p", "id"), ("m", "player_id")),) and nested.group_by == ("m.band_id", "m.part")
    assert nested.item("players").aggregate and nested.item("names").aggregate and not nested.item("part").aggregate


def test_case_branches_are_lineage(spark):
    q = Analyser(spark).query("SELECT t.id AS id, CASE WHEN t.a = 1 THEN t.b ELSE t.c END AS v FROM t t")
    assert {c for _, c in q.item("v").columns} == {"a", "b", "c"}


def test_routes(spark):
    found = {(r.view, r.table, r.role): set(r.columns) for r in routes(Analyser(spark), MAPPING)}
    assert found["", "concert", "main"] == {"no", "starts", "subtitle", "title", "band_id", "town", "venue_code"}
    assert found["band", "membership", "main_join"] == {"band_id", "part", "player_id"} and found["band", "player", "slave"] == {"id", "name"}
    assert found["venue", "venue", "main_join"] == {"label", "seats", "town", "code", "opened"} and found["venue", "concert", "owner"] == {"town", "venue_code"}
    assert found["prices", "ticket", "main"] == {"price", "concert_no"} and found["prices", "concert", "owner"] == {"no"}


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT a.id AS id FROM a a JOIN b b ON a.x > b.x",
        "SELECT a.id AS id FROM a a JOIN b b ON a.x = b.x OR a.y = b.y",
        "SELECT a.id AS id FROM a a CROSS JOIN b b",
        "SELECT a.id AS id FROM a a JOIN b b ON b.x = 1",
        "SELECT a.id AS id FROM a a UNION SELECT b.id FROM b b",
    ],
)
def test_unsupported_joins(spark, sql):
    with pytest.raises(MappingError):
        Analyser(spark).query(sql)


def test_literal_in_nested_on(spark):
    assert len(Analyser(spark).query("SELECT a.id AS id FROM a a JOIN b b ON b.x = a.x AND b.kind = 1", check=False).tables) == 2


@pytest.mark.parametrize(
    "mapping",
    [
        Mapping("x", "SELECT a.id AS id FROM a a WHERE a.x = 1"),
        Mapping("x", "SELECT a.id AS id FROM a a", fields=(Field("f", "array-sql", sql="SELECT b FROM c LIMIT 1", on_main="WHERE b = #{id}"),)),
        Mapping("x", "SELECT a.id AS id FROM a a", fields=(Field("f", "array-sql", sql="SELECT b FROM c", on_main="WHERE b = #{id} GROUP BY b"),)),
        Mapping("x", "SELECT a.id AS id FROM a a", fields=(Field("f", "array-sql", sql="SELECT b FROM c", on_main="WHERE b = 1"),)),
        Mapping("x", "SELECT a.id AS id FROM a a", fields=(Field("f", "what"),)),
    ],
)
def test_checks(mapping):
    with pytest.raises(MappingError):
        mapping.check()


def test_yaml(tmp_path):
    text = textwrap.dedent(
        """
        destination: log
        adapterNamePattern: 'es-*'
        esMapping:
          env: dev
          _index: faq
          pk: id
          write-null: true
          sql: "SELECT q.id AS id, q.words AS words FROM q q"
          objFields:
            words:
              type: array
              paramArray: {split: '[;]', classType: java.lang.Integer}
            vec:
              type: llm-vector
              paramLlmVector: {apiKey: "${key}", baseUrl: "${url:none}"}
        """
    )
    (tmp_path / "a.yml").write_text(text)
    (tmp_path / "b.yml").write_text(text.replace("env: dev", "env: prod"))
    found = load_mappings(str(tmp_path), "dev", {"key": "k1"})
    assert list(found) == ["a.yml"]
    m = found["a.yml"]
    assert m.index == "faq" and m.write_null and m.fields[0].split == "[;]" and m.fields[0].element_type == "int"
    assert m.fields[1].params == {"apiKey": "k1", "baseUrl": "none"}
    assert digest(m) != digest(from_dict({"index": "faq", "sql": "SELECT 1 AS id FROM q"}))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.yml").write_text(text)
    with pytest.raises(MappingError):
        load_mappings(str(tmp_path))


def test_adapter_patterns():
    assert fits_adapter("*", "x") and fits_adapter("es-*", "es-one") and not fits_adapter("es-*", "es-one-two") and fits_adapter("**-two", "es-one-two")
