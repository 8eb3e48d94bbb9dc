import random
from collections import Counter

import pytest

from stratalens.llm import origin as O

HAND = "package a\n\nimport \"log\"\n\n// keeps the order\nfunc LoadRows(rows []int, size int) int {\n\tfirstRow := openReader(rows, 3)\n\tif size > 4 {\n\t\tlog.Printf(\"x\", firstRow)\n\t\treturn firstRow\n\t}\n\tfor _, oneRow := range rows {\n\t\ttotalSize := oneRow * 2\n\t\tstoreTotal(totalSize)\n\t}\n\treturn size\n}\n"


@pytest.fixture(scope="module")
def models():
    return {"go": O.Names(Counter(O.identifiers(HAND) * 5)), "javascript": O.Names(dict.fromkeys("loadRows openReader firstRow totalSize storeTotal renderPage checkInput".split(), 20))}


def test_classes(models):
    rnd = random.Random(1)
    mini = "!function(e,t){" + "".join(f"var _{rnd.choice('abcdef')}{i}=t.{rnd.choice('xyz')}(e,{i});" for i in range(90)) + "}();"
    acc = "package a\n" + "".join(f"\nfunc (m *Row{i}) GetName{i}() string {{\n\treturn m.f{i}\n}}\n" for i in range(12))
    data = "var rows = []string{\n" + "".join(f'    "{rnd.randrange(10**40):040d}",\n' for i in range(60)) + "}\n"
    cases = [
        (HAND, "src/a.go", "go", None), ("", "a.go", "go", None), (acc, "src/b.go", "go", "generated"), (mini, "src/x.js", "javascript", "minified"), ("package a\n\n" + data, "src/d.go", "go", "payload"),
        ("// Code generated by rowgen. DO NOT EDIT.\n" + HAND, "src/a.go", "go", "generated"), ("// skips sources that carry a DO NOT EDIT line\n" + HAND, "src/a.go", "go", None),
        ("// do not edit the order of rows below without the owners\n" + HAND, "src/a.go", "go", None), (HAND + '\nvar note = "Code generated by x. DO NOT EDIT."\n', "tools/codegen/a.go", "go", None),
        (HAND, "third_party/lib/row-kit/a.go", "go", "vendored"), (HAND, "src/vendor_portal/a.go", "go", None), ("// Vendored from code.example/row-kit at 1a2b3c\n" + HAND, "src/a.go", "go", "vendored"),
        ("/*\n * Copyright 2021 row team, our own code.\n */\n" + HAND, "src/a.go", "go", None), ('{\n  "lockfileVersion": 3\n}\n', "web/package-lock.json", "json", "lock"), ('{"a": 1}', "config/a.json", "json", None),
        ("var small = []int{\n    1, 2, 3,\n    4, 5, 6,\n}\n", "src/t.go", "go", None), (HAND, "api/gen/x/a.pb.go", "go", "generated"),
    ]
    for text, path, lang, want in cases:
        assert O.classify(text, path, lang, models) == want, (path, want, text[:60])


def test_rows(spark):
    d = spark.createDataFrame([(1, "a.go", "go", HAND), (1, "a.go", "go", HAND), (2, None, None, HAND), (3, "b.go", "go", None), (4, "third_party/x/y/z.go", "go", HAND)], "file_id long, path string, language string, content string")
    got = {tuple(r) for r in O.labelled(d, O.train(d)).collect()}
    assert got == {(1, "hand"), (2, "hand"), (4, "vendored")}
    assert O.labelled(d.limit(0), O.train(d.limit(0))).count() == 0


def test_models_count_all_files(spark):
    rows = [(i, "go", f"package a\n\nfunc loadRow{i % 7}(size int) int {{ return size }}\n") for i in range(3200)]
    d = spark.createDataFrame(rows + rows[:50] + [(9000, "go", ""), (9001, "text", "word"), (9002, "go", "// Code generated by rowgen. DO NOT EDIT.\nfunc made() {}\n")], "file_id long, language string, content string")
    got = O.train(d.repartition(5))
    words = Counter(w for _, _, t in rows for w in O.identifiers(t))
    want = O.Names(words)
    assert set(got) == {"go"} and got["go"].n == want.n and got["go"].d == want.d and got["go"].mean == want.mean
    # the mean is that of all names
    assert want.d["^^"] == words.total() and abs(want.mean - sum(want.bits(w) * k for w, k in words.items()) / words.total()) < 1e-6


def test_comments_are_found_by_both_patterns():
    for text in ["a // b\nc", "// b", "a/*x\ny*/b", "a//b", "#[x]\n# y\nz", " #!a\n/* open", "x\t# y /* z\n*/", "/**/ /*/ */ //", "a\r// b", "u\u2028// c", "\n\n#a\n", "/ /* x */#b", "é# x\n/# y", "## # x", "/// x\n//", "*/ # a"]:
        assert O._MARKED.sub(" ", text) == O._COMMENTS.sub(" ", text), text
    assert O.uncommented('  """doc\n"""\nx = 1 # y') == " \nx = 1  "
