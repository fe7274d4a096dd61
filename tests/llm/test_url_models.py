from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from curbside.llm import url_models as um
from curbside.llm.queries import URL_SQL
from tests.llm import helpers as h


def pages(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)


def made(rng, n):
    hosts = [f"{a}.example.{t}" for a in ("www.news", "blog", "casino", "shop") for t in ("com", "org", "net")]
    return [
        f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}/{rng.choice(['en', 'fr', 'de', 'es'])}/{rng.randrange(3000)}"
        + rng.choice(["", "?a=1", "#top", "/x.html"])
        for _ in range(n)
    ]


def brute(urls):
    """(host, path, rule, verdict, score) of each URL by loops over letters."""
    order, split = um.ORDER, []
    for url in urls:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = rest
        for mark in "/?#":
            host = host.split(mark, 1)[0]
        path = rest[len(host) :].split("?", 1)[0].split("#", 1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [r for r in um.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
        split.append((host, path, best and best[1] + best[2], best and best[0]))
    texts = {a + b: d for a, b, _, d in split}
    aside = {t: d is not None and hashlib.md5(t.encode()).hexdigest() < um.ASIDE for t, d in texts.items()}
    grams = {t: [(um.START * (order - 1) + t + um.END)[i : i + order] for i in range(len(t) + 1)] for t in texts}
    counts = {side: Counter() for side in (um.ALLOW, um.BLOCK)}
    kinds = {side: Counter() for side in counts}
    for t, d in texts.items():
        if d and not aside[t]:
            for g in grams[t]:
                for k in range(1, order + 1):
                    counts[d][g[-k:]] += 1
    letters = len({g[-1] for t in texts for g in grams[t]})
    whole = {side: Counter() for side in counts}
    for side, seen in counts.items():
        for g, n in seen.items():
            whole[side][len(g), g[:-1]] += n
            kinds[side][len(g), g[:-1]] += 1

    def chance(side, g):
        if not g:
            return 1 / letters
        n, u = whole[side][len(g), g[:-1]], kinds[side][len(g), g[:-1]]
        shorter = chance(side, g[1:])
        return (counts[side][g] + u * shorter) / (n + u) if n else shorter

    score = {
        t: sum(math.log(chance(um.ALLOW, g)) - math.log(chance(um.BLOCK, g)) for g in grams[t]) / (len(t) + 1)
        for t in texts
    }
    step = {t: math.floor(round(s, 6) * um.STEPS) for t, s in score.items()}
    sides = [[step[t] for t, d in texts.items() if aside[t] and d == side] for side in (um.ALLOW, um.BLOCK)]
    cut = 0
    if all(sides):
        ends = {x + k for side in sides for x in side for k in (0, 1)}
        error = lambda c: sum(x < c for x in sides[0]) / len(sides[0]) + sum(x >= c for x in sides[1]) / len(sides[1])
        cut = min(ends, key=lambda c: (round(error(c), 9), abs(c), c))
    return [
        (host, path, rule, verdict or (um.ALLOW if step[host + path] >= cut else um.BLOCK), score[host + path])
        for host, path, rule, verdict in split
    ]


def same(got, want):
    assert [r[1:5] for r in got] == [w[:4] for w in want]
    assert [r[5] for r in got] == pytest.approx([w[4] for w in want], abs=2e-6)


ODD = [
    None, "", "no address", "://", "http://", "http://ORG/", "http://org", "http://xorg/a", "https://A.B.Org/x?y://z",
    "http://example.org/es/1", "http://a.example.org/en/15", "http://aexample.org/en/15", "http://com/fr/", "http://é.com/fr/ü",
    "ftp://u@h.net:80/p", "http://h?q/r", "http://h#f/r", "x://y://z", "http://a.com/de/", "http://a.com/de", "http://example.org/en/2",
]


def test_hosts_paths_rules_and_scores_are_those_of_brute_force(spark):
    urls = made(random.Random(1), 500) + ODD + ["http://a.org/same"] * 40
    same(sorted(um.judge_urls(pages(spark, urls)).collect()), brute(urls))


def test_few_rules_or_none(spark):
    for urls in (["http://a.net/1", "http://b.net/2", None], ["http://a.org/"], ["http://a.com/de/1", "http://b.net/"]):
        same(sorted(um.judge_urls(pages(spark, urls)).collect()), brute(urls))
    assert um.judge_urls(pages(spark, ["http://a.net/1"])).first()["verdict"] == um.ALLOW


def test_rare_grams_meet_their_letters_in_a_shuffle(spark, monkeypatch):
    urls = made(random.Random(2), 300) + ODD
    monkeypatch.setattr(um, "FREQUENT", 60)
    same(sorted(um.judge_urls(pages(spark, urls)).collect()), brute(urls))
    split = um.parted(pages(spark, urls))
    odds = um.gram_odds(um.count_grams(um.different_texts(split)))
    total = odds.agg(F.sum("n")).first()[0]
    assert 0 < odds.where(F.col("n") * 60 >= total).count() <= 60


def test_the_models_tell_learned_habits_apart(spark):
    """Blocked Spanish pages teach the model about Spanish pages without a rule."""
    urls = made(random.Random(3), 1500)
    rows = um.judge_urls(pages(spark, urls)).where("rule IS NULL").collect()
    blocked = {lang: [r["verdict"] == um.BLOCK for r in rows if f"/{lang}/" in r["path"]] for lang in ("es", "fr")}
    assert sum(blocked["es"]) > 0.9 * len(blocked["es"]) and sum(blocked["fr"]) < 0.1 * len(blocked["fr"])


def test_same_as_sql_on_odd_urls(spark):
    urls = made(random.Random(5), 400) + ODD
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(urls)))
    found = con.execute(URL_SQL)
    names = [d[0] for d in found.description]
    df = um.judge_urls(pages(spark, urls)).select(*names)
    assert sorted(tuple(r) for r in df.collect()) == sorted(found.fetchall())


def test_awkward_rows(spark):
    rows = [(1, None), (1, "http://a.org/x"), (1, "http://a.org/x"), (None, "http://a.com/de/"), (2, "http://b.net/" + "y" * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string").select(
        "*", F.lit("t").alias("text"), F.lit(1).alias("id"), F.lit(2.0).alias("score"), F.lit("r").alias("rule"),
        F.lit("g").alias("gram"), F.lit("h").alias("host"), F.lit(0).alias("text0"),
    )
    got = um.judge_urls(df)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "score"] and got.count() == 5
    kept = um.allowed_pages(df)
    assert kept.columns == df.columns and 2 <= kept.count() < 5
    nothing = pages(spark, []).limit(0)
    assert um.judge_urls(nothing).count() == 0 == um.allowed_pages(nothing).count()


def test_the_main_path_has_no_python(spark):
    plan = um.judge_urls(pages(spark, made(random.Random(7), 50)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapIn" not in plan


@pytest.mark.parametrize("n", [1, 2])
def test_repeated_urls_teach_once(spark, n):
    urls = made(random.Random(9), 200)
    once = {r["path"] + r["host"]: r["score"] for r in um.judge_urls(pages(spark, urls)).collect()}
    more = {r["path"] + r["host"]: r["score"] for r in um.judge_urls(pages(spark, urls * n)).collect()}
    assert once == more
