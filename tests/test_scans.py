import json

from pyspark.sql import functions as F

from strataq.operators import pages
from strataq.sources import scans


def test_lockfiles(spark):
    new = json.dumps({"packages": {"": {"version": "0"}, "node_modules/a": {"version": "1.0.0"}, "node_modules/b/node_modules/@s/c": {"version": "2.0.0"}}})
    yarn = '"@s/c@^1", "@s/c@^2":\n  version "2.5.0"\n\na@^1:\n  version "1.1.0"\n'
    pnpm = "packages:\n  /a@1.2.3:\n    x: y\n  '@s/c@4.5.6':\n  /d/7.8.9:\n  e@1.0.0(react@18.2.0):\n  overrides:\n"
    r = spark.createDataFrame([(new, yarn, pnpm)], "new string, yarn string, pnpm string").select(
        scans.npm_packages(F.col("new")), scans.yarn_packages(F.col("yarn")), scans.pnpm_packages(F.col("pnpm"))
    ).first()
    got = [sorted((p.package, p.version) for p in x if p.package) for x in r]
    assert got == [[("@s/c", "2.0.0"), ("a", "1.0.0")], [("@s/c", "2.5.0"), ("a", "1.1.0")], [("@s/c", "4.5.6"), ("a", "1.2.3"), ("d", "7.8.9"), ("e", "1.0.0")]]


def test_heap_profile(spark, tmp_path):
    (tmp_path / "p").write_text("heap_v2/2097152\n@ 0x1 0x2\n  t*: 2: 1000 [0: 0]\n@ 0x3\n  t*: 0: 0 [0: 0]\nMAPPED_LIBRARIES:\n@ 0x9\n  t*: 1: 1 [0: 0]\n00400000-0040b000 r-xp 00000010 08:01 17 /bin/a\n0050b000-0050c000 rw-p 0 08:01 17 /bin/a\n")
    r = scans.heap_stacks(scans.whole_files(spark, f"{tmp_path}/p")).collect()
    assert [(x.stack, x.n, x.bytes) for x in r] == [(["0x1", "0x2"], 2, 1000)]
    r = scans.mapped_ranges(scans.whole_files(spark, f"{tmp_path}/p")).collect()
    assert [tuple(x)[1:] for x in r] == [(0x400000, 0x40B000, 16, "/bin/a")]


def test_urls(spark):
    urls = ["https://m.a.com/x/?utm_source=q&id=3&ref=z#top", "http://www.b.org/", "https://a.com/p?page=2"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(pages.canonical_url(F.col("u"))).collect()]
    assert got == ["https://a.com/x/?id=3", "http://b.org", "https://a.com/p"]


def test_tsv_and_dot(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    scans.write_tsv(df, f"{tmp_path}/t")
    assert sorted(map(tuple, scans.read_tsv(spark, f"{tmp_path}/t", "k string, n int").collect())) == [("a", 1), ("b", 2)]
    assert '"a" -> "b";' in scans.to_dot([("a", "b")])
    assert scans.to_dot([("a", 'b"')], "g", {"a": "red", 'b"': "red,blue"}) == 'digraph g {\n  "a" [style=filled, fillcolor="red"];\n  "b\\"" [style=wedged, fillcolor="red:blue"];\n  "a" -> "b\\"";\n}\n'
    assert scans.resolve({"x": "x_exp"}, "x") == "x_exp" and scans.resolve({}, "x") == "x"


def test_older_lockfiles_nest_with_fields_in_any_order(spark, tmp_path):
    old = {"lockfileVersion": 1, "dependencies": {
        "keyv": {"resolved": "https://r.org/keyv", "version": "4.5.4", "requires": {"json-buffer": "3.0.1"}},
        "flat-cache": {"version": "3.2.0", "dependencies": {"@s/c": {"dependencies": {"deep": {"dev": True, "version": "0.1.0", "dependencies": {}}}, "version": "3.0.0"}, "nameless": {}}},
    }}
    (tmp_path / "r1__package-lock.json").write_text(json.dumps(old))
    (tmp_path / "r2__package-lock.json").write_text("not json")
    (tmp_path / "r3__package-lock.json").write_text(json.dumps({"packages": {"node_modules/a": {"version": "1.0.0"}}, "dependencies": {"a": {"version": "1.0.0"}}}))
    (tmp_path / "r4__yarn.lock").write_text('b@^1:\n  version "1.1.0"\n')
    got = sorted(map(tuple, scans.locked(scans.whole_files(spark, f"{tmp_path}/*")).collect()), key=repr)
    assert got == sorted([("r1", "keyv", "4.5.4"), ("r1", "flat-cache", "3.2.0"), ("r1", "@s/c", "3.0.0"), ("r1", "nameless", None), ("r1", "deep", "0.1.0"), ("r3", "a", "1.0.0"), ("r4", "b", "1.1.0")], key=repr)
    bad = spark.createDataFrame([("keyv", "4.5.4"), ("@s/c", "9.9.9")], "package string, version string")
    flags = {r.package: r.flag for r in scans.flagged(scans.locked(scans.whole_files(spark, f"{tmp_path}/*")), bad).collect()}
    assert flags == {"keyv": scans.COMPROMISED, "@s/c": "OK"}


def test_dependencies_outside_the_registry(spark):
    outside = ["git+ssh://git@h.org:o/r.git#v1", "git://h.org/r", "https://h.org/x.tgz", "user/repo", "user/repo#semver:^5", "github:o/r", "gitlab:o/r", "gist:11081aaa281", "git@github.com:o/r.git"]
    inside = ["^1.2.3", "1.x", "latest", "npm:@s/other@1.0.0", "file:../foo/bar", "workspace:*", "*", "", ">=1.0.2 <2.1.2", "~/x/y"]
    df = spark.createDataFrame([(x, True) for x in outside] + [(x, False) for x in inside], "spec string, want boolean")
    assert df.where(scans.not_registry(F.col("spec")) != F.col("want")).collect() == []


def test_nested_packages_are_opened_in_one_pass(spark, monkeypatch):
    """No level is written for the next one; deep files, large ones, repeated keys and odd entries keep their packages."""

    def written(*_, **__):
        raise AssertionError("a level was written")

    monkeypatch.setattr(type(spark.range(1)), "checkpoint", written)
    flat = json.dumps({"dependencies": {f"p{i}": {"version": str(i)} for i in range(60_000)}})
    odd = '\n{"dependencies": {"a": {"version": "1"}, "a": {"version": "2"}, "b": "1.0.0", "c": {"version": 5}, "e": {"version": {"z": 1, "a": "é"}}, "s\\ud800": {"dependencies": [{"dependencies": {"f": {"version": null}}}]}, "g": {"dependencies": "h"}}} <<<'
    deep = '{"version": "1", "dependencies": {"d": ' * 600 + '{"version": "0"}' + "}}" * 600
    nothing = [None, "", "{", "5", "[1]", "null", "{}", '{"dependencies": null}', '{"dependencies": "x"}', '{"dependencies": {"a": {"version": NaN}}}', '{"dependencies": {"a\tb": {}}}']
    texts = {"deep": deep, "flat": flat, "odd": odd} | {f"none{i}": v for i, v in enumerate(nothing)}
    files = spark.createDataFrame(list(texts.items()), "path string, value string")
    opened = scans.nested_packages(files)
    assert opened.dtypes == [("path", "string"), ("package", "string"), ("version", "string"), ("depth", "int")]
    got = sorted(map(tuple, opened.collect()), key=repr)
    want = [("deep", "d", "0" if i == 599 else "1", i) for i in range(600)] + [("flat", f"p{i}", str(i), 0) for i in range(60_000)]
    want += [("odd", p, v, n) for p, v, n in (("a", "2", 0), ("b", None, 0), ("c", "5", 0), ("e", '{"a":"é","z":1}', 0), ("s?", None, 0), (None, None, 1), ("f", None, 2), ("g", None, 0))]
    assert got == sorted(want, key=repr)
