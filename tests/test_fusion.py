"""Fusion by names of texts, against the same rules in plain Python, and how often a text is carried."""

import random

import pytest
from pyspark.sql import functions as F

from factlake.operators import engine as N
from factlake.operators import retrieval as R
from factlake.plans import catalogue as C
from factlake.plans import engine as G
from factlake.sources import facts as S

LEG = "query_id long, scope string, id string, ord long, link_id string, score double"
LONG = "word " * 40


def plain(cos, lex, bar, gated):
    """Rows (query_id, ord, id, link_id, data, score) to query_id, key, cosine_rank, lexical_rank."""
    out = set()
    for q in {r[0] for r in cos + lex}:
        names, left, right = {}, {}, {}
        rows = sorted((r[1], r[2] or "", " ".join((r[4] or "").split())) for r in cos if r[0] == q)
        rows = [(o, i or t, t) for o, i, t in rows if i or t]
        for o, slot, text in rows:
            names.setdefault(slot, slot)
            if text:
                names.setdefault(text, slot)
        for o, slot, _ in rows:
            left.setdefault(names[slot], o)
        placed = sorted((r for r in lex if r[0] == q and r[5] >= bar), key=lambda r: r[1])
        for place, (_, _, _, link, data, _) in enumerate(placed, 1):
            text = " ".join((data or "").split())
            key = names.get(link) or names.get(text) or (link if link is not None else text)
            if key:
                right.setdefault(key, place)
        out |= {(q, k, left.get(k), right.get(k)) for k in (left if gated else left | right)}
    return out


@pytest.mark.parametrize("gated", [False, True])
def test_fusion_by_names_equals_fusion_by_texts(spark, gated):
    """Long and short texts, copies of other spacing, blank and null ones, texts that are ids, ids longer than a name, and links."""
    rnd, data = random.Random(3), {}
    ids = [str(i) for i in range(24)] + ["i" * 80, "alpha", LONG.strip(), "", "k" * 80]
    pool = [LONG, f"  {LONG.replace(' ', '   ')}", LONG + "end", "alpha", " alpha ", "3", "", None, "i" * 80, "x" * R.SHORT, "x" * (R.SHORT + 1)]
    for i in ids:
        data[i] = rnd.choice(pool)
    leg = lambda linked: [(q, o, i, rnd.choice([None, None, *ids, "absent", "z" * 90]) if linked else None, data[i], round(1 - o / 20, 3)) for q in range(8) for o, i in enumerate(rnd.sample(ids, 12), 1)]
    cos, lex = leg(False), leg(True)
    rows = lambda own: spark.createDataFrame([(q, "en", i, o, link, s) for q, o, i, link, _, s in own], LEG)
    facts = spark.createDataFrame([("en", i, t) for i, t in data.items()] + [("fr", "3", "other")], "scope string, id string, data string")
    (c, near), (x, worded) = R.named(rows(cos), facts), R.named(rows(lex), facts)
    assert "data" not in c.columns + x.columns and near.count() == len({r[2] for r in cos})  # each text once, not once a query
    want, found = plain(cos, lex, 0.5, gated), lambda df: {(r.query_id, r.key, r.cosine_rank, r.lexical_rank) for r in df.collect()}
    assert found(R.fuse(c, x, least_lexical=0.5, gated=gated, texts=near.unionByName(worded))) == want
    text = lambda own: rows(own).join(facts.filter("scope = 'en'").drop("scope"), "id")
    assert found(R.fuse(text(cos), text(lex), least_lexical=0.5, gated=gated)) == want


def test_legs_fetch_each_text_once(spark):
    """Many queries hit the same facts: the legs carry names of one length at most, and texts hold a row a fact."""
    cos, lex, texts = C._legs(spark, "/root/testdata/sf0.001", linked=True)
    assert cos.count() + lex.count() > texts.count() == cos.select("scope", "id").distinct().count() + lex.select("scope", "id").distinct().count()
    for leg in (cos, lex):
        assert "data" not in leg.columns and leg.agg(F.max(F.length("name"))).first()[0] <= R.SHORT + 1


def test_floors_and_counts_carry_no_texts(spark, monkeypatch):
    """A hit is taken to all floors by its name, and ids come from names."""
    sf, met, fuse = "/root/testdata/sf0.001", [], R.fuse_names
    monkeypatch.setattr(R, "fuse_names", lambda cos, lex, *a, **k: met.append(cos.columns + lex.columns) or fuse(cos, lex, *a, **k))
    asked, options = G._query_table(spark, sf).filter("query_id < 8"), N.SearchOptions(limit=5, least_lexical=0.1)
    got = N.at_floors(asked, S.facts(spark, sf), S.vectors(spark, sf), S.NOW, [0.0, 0.2], options).collect()
    facts = {r.id: " ".join((r.data or "").split()) for r in S.facts(spark, sf).collect()}
    assert len(met) == 1 and "data" not in met[0] and {r.floor for r in got} == {0.0, 0.2}
    assert all(r.key == r.id if r.cosine_rank is not None else r.key == facts[r.id] for r in got) and any(r.cosine_rank is None for r in got)
