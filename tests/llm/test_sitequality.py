import messy
import numpy as np
import pytest

from dinestat.llm import sitequality as sq


def test_logistic_regression_finds_the_weights():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (20_000, 3))
    good = rng.random(20_000) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1] + 0.5)))
    model = sq.fit_logistic(x, good.astype(float))
    assert model.weights / np.append(model.scale, 1) == pytest.approx([1.5, -1, 0, 0.5], abs=0.1)


def test_prior_weight_is_that_of_the_drawn_sites(spark):
    rng = np.random.default_rng(1)
    for weight in (5.0, 60.0):
        rates = rng.beta(0.7 * weight, 0.3 * weight, 3000)
        n = rng.integers(1, 200, 3000)
        rows = [(f"h{i}", "", float(k), float(rng.binomial(k, p))) for i, (k, p) in enumerate(zip(n, rates, strict=True))]
        drawn = spark.createDataFrame(rows, "host string, path string, n double, good double")
        found = sq.site_sums(drawn.selectExpr("*", "good as squares", "n as shares"))[1]
        assert found.host == pytest.approx(weight, rel=0.25)
        assert found.path == sq.HEAVIEST  # no host has two paths


def plain_posteriors(paths):
    """Of {(host, path): probabilities}: (host, path) posteriors, as the formulas stand."""

    def weight(groups, parent):
        filled = [k for k in groups if len(groups[k]) >= sq.FILLED]
        apart = chance = free = inside = freedom = 0.0
        for k in filled:
            x, siblings = groups[k], [v for j, v in groups.items() if parent(j) == parent(k)]
            everyone, n = np.concatenate(siblings), len(x)
            inside += ((x - x.mean()) ** 2).sum()
            freedom += n - 1
            apart += (x.mean() - everyone.mean()) ** 2
            up = len(everyone)
            chance += 1 / n - 2 / up + 1 / up
            free += 1 - 2 * n / up + sum(len(v) ** 2 for v in siblings) / up**2
        between = (apart - inside / freedom * chance) / free
        return min(max(inside / freedom / between, sq.LIGHTEST), sq.HEAVIEST) if between > 0 else sq.HEAVIEST

    hosts = {}
    for (host, _), x in paths.items():
        hosts[host] = np.concatenate((hosts.get(host, []), x))
    rate = np.concatenate(list(hosts.values())).mean()
    w_host, w_path = weight(hosts, lambda k: ""), weight(paths, lambda k: k[0])
    of_host = {h: (x.sum() + w_host * rate) / (len(x) + w_host) for h, x in hosts.items()}
    of_path = {k: (x.sum() + w_path * of_host[k[0]]) / (len(x) + w_path) for k, x in paths.items()}
    return of_host, of_path, rate


def test_posteriors_of_sparse_hosts(spark):
    rng = np.random.default_rng(3)
    paths, true = {}, {}
    for i in range(500):
        middle = rng.normal(0.5, 0.15)
        for j in range(rng.integers(1, 4)):
            true[f"h{i}", f"/{j}/"] = mean = middle + rng.normal(0, 0.08)
            size = rng.integers(1, 4) if rng.random() < 0.7 else rng.integers(5, 40)
            paths[f"h{i}", f"/{j}/"] = np.clip(rng.normal(mean, 0.2, size), 0, 1)
    rows = [(*k, float(len(x)), float(x.sum()), float((x * x).sum()), float(len(x))) for k, x in paths.items()]
    sums = spark.createDataFrame(rows, "host string, path string, n double, good double, squares double, shares double")
    posts, priors = sq.site_sums(sums)
    of_host, of_path = priors.posterior()
    found = posts.select("host", "path", of_host.alias("of_host"), of_path.alias("of_path")).collect()
    plain_host, plain_path, rate = plain_posteriors(paths)
    assert len(found) == len(paths) and sq.LIGHTEST < priors.host < 10 and 2 < priors.path < 30
    for r in found:
        assert r["of_host"] == pytest.approx(plain_host[r["host"]], abs=1e-9)
        assert r["of_path"] == pytest.approx(plain_path[r["host"], r["path"]], abs=1e-9)
    sparse = [k for k in paths if len(paths[k]) < 4]
    drawn, own, pooled = (
        np.mean([(value(k) - true[k]) ** 2 for k in sparse])
        for value in (lambda k: plain_path[k], lambda k: paths[k].mean(), lambda k: rate)
    )
    assert drawn < 0.8 * own and drawn < 0.8 * pooled


def test_a_document_is_no_evidence_for_itself(spark):
    texts = [(i, "good plain words " * 30 if i % 2 else "### $$$ %%% " * 40, "en", "s") for i in range(60)]
    sites = [(i, f"h{i}", "/") for i in range(60)]  # alone at its site
    known = [(i, i % 2, 0) for i in range(60)]
    out = sq.site_quality(messy.documents(spark, texts), messy.labels(spark, known), site_rows(spark, sites)).collect()
    for r in out:
        assert r["score"] == pytest.approx(min(max(r["doc_score"], sq.LOW), sq.HIGH), abs=1e-9)


def site_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, host string, path string")


def test_posteriors_as_by_hand(spark):
    rng = np.random.default_rng(2)
    texts = [(i, "good plain words " * 30 if rng.random() < 0.6 else "### $$$ %%% " * 40, "en", "s") for i in range(200)]
    known = [(i, int("good" in t), 0) for i, t, *_ in texts[:80]]
    sites = [(i, f"h{i % 4}" if i % 4 else "h0", f"/p{i % 3}/") for i in range(180)]
    out = sq.site_quality(messy.documents(spark, texts), messy.labels(spark, known), site_rows(spark, sites)).collect()
    assert len(out) == 200
    by_path = {}
    for r in out:
        by_path.setdefault((r["host"], r["path"]), []).append(r)
    rate = np.mean([r["doc_score"] for r in out])
    for (host, _), rows in by_path.items():
        own = [r["doc_score"] for r in out if r["host"] == host]
        assert min(np.mean(own), rate) - 1e-9 <= rows[0]["host_score"] <= max(np.mean(own), rate) + 1e-9
        mean, prior = np.mean([r["doc_score"] for r in rows]), rows[0]["host_score"]
        assert min(mean, prior) - 1e-9 <= rows[0]["path_score"] <= max(mean, prior) + 1e-9
    assert {r["host"] for r in out if r["doc_id"] >= 180} == {""}
    assert all(r["good"] == ("good" in texts[r["doc_id"]][1]) for r in out)


def test_held_out_rows(spark):
    given = "/root/testdata/sf0.1"
    docs, labels, pages = (spark.read.parquet(f"{given}/{t}.parquet") for t in ("documents", "labels", "pages"))
    found = sq.site_quality(docs, labels.where("doc_id % 3 <> 0"), sq.page_sites(pages), source_col="source")
    rows = found.join(labels.where("doc_id % 3 = 0"), "doc_id").select("quality", "good").collect()
    assert np.mean([r["good"] for r in rows if r["quality"]]) > 0.98
    assert np.mean([r["good"] for r in rows if not r["quality"]]) < 0.1


def test_a_document_of_two_sites_counts_at_both(spark):
    texts = [(i, "good plain words " * 30 if i % 2 else "### $$$ %%% " * 40, "en", "s") for i in range(60)]
    texts += [(100, "good plain words " * 30, "en", "s"), (100, "good plain words " * 30, "en", "s"), (101, "good plain words " * 30, "en", "s")]
    known = [(i, i % 2, 0) for i in range(60)]
    sites = [(i, "a" if i % 2 else "spam", "/p/") for i in range(60)]
    sites += [(100, "a", "/p/"), (100, "spam", "/p/"), (100, "spam", "/p/"), (101, "a", "/p/")]
    out = sq.site_quality(messy.documents(spark, texts), messy.labels(spark, known), site_rows(spark, sites)).collect()
    assert len(out) == 63
    by = {r["doc_id"]: r for r in out}
    assert (by[100]["host"], by[100]["path"]) == ("a", "/p/")
    assert by[100]["path_score"] == pytest.approx((by[0]["path_score"] + by[1]["path_score"]) / 2)

    def odds(p):
        return np.log(p / (1 - p))

    good, bad = by[1]["doc_score"], by[0]["doc_score"]
    assert by[100]["doc_score"] == by[101]["doc_score"] == good
    parts = {"a": [(1, good)] * 31 + [(0.5, good)] * 2, "spam": [(1, bad)] * 30 + [(0.5, good)] * 2}
    sums = [(h, "/p/", *(float(sum(f(w, x) for w, x in v)) for f in (lambda w, x: w, lambda w, x: w * x, lambda w, x: w * x * x, lambda w, x: w * w))) for h, v in parts.items()]
    priors = sq.site_sums(spark.createDataFrame(sums, "host string, path string, n double, good double, squares double, shares double"))[1]

    def without(host):
        n = sum(w for w, _ in parts[host]) - 0.5
        x = sum(w * x for w, x in parts[host]) - 0.5 * good
        return (x + priors.path * (x + priors.host * priors.rate) / (n + priors.host)) / (n + priors.path)

    middle = np.mean([odds(without(h)) for h in parts]) - odds(priors.rate)
    assert odds(by[100]["score"]) == pytest.approx(odds(good) + middle, rel=1e-6)
    assert by[100]["score"] < by[101]["score"]


def test_sites_of_pages(spark):
    rows = [("https://A.example.com/en/12?x=3",), ("http://b.org/7.html",), ("http://b.org/x/",), (None,), ("none",), ("http://b.org/en/99999999999999999999",)]
    found = [tuple(r) for r in sq.page_sites(spark.createDataFrame(rows, "url string")).collect()]
    assert found[:2] == [(12, "a.example.com", "/en/"), (7, "b.org", "")]
    assert [r[0] for r in found[2:]] == [None] * 4


def test_messy_rows(spark):
    docs, sites = messy.documents(spark), site_rows(spark, [(1, "h", None), (1, "a", "/x/"), (None, "h", "/"), (2, None, "/")])
    for known in (messy.labels(spark), messy.labels(spark).limit(0)):
        rows = sq.site_quality(docs, known, sites, source_col="source").collect()
        assert sorted((r["doc_id"] for r in rows), key=str) == sorted((i for i, *_ in messy.TEXTS), key=str)
        assert [(r["host"], r["path"]) for r in rows if r["doc_id"] == 1] == [("a", "/x/")]
        assert {r["host"] for r in rows if r["doc_id"] == 2} == {"a"}
        assert all(0 <= r["score"] <= 1 for r in rows)
    assert sq.site_quality(docs.limit(0), messy.labels(spark), sites).count() == 0
