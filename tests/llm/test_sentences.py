import pytest

from stratalens.llm.sentences import language_of, p9_found, sentences

CASES = [
    "Read the a resp. the b, but never both…| ratio.denseKnoll is called.| We wait... and then retry it.", "This covers parsing, linking, etc.| The meter is handled elsewhere.", 'The log says "Retry later." and then x.y stops.| Fine.', '"It works."| That is all the report says.',
    'The alert reads "Queue full. Dropping writes." until f_g restarts.| Then go.', '"Is the glyph warm?" asks the runbook before every deploy.', "The job starts at 2 a.m. and rebuilds it.| Why does flatVector return null here?| Nobody knows",
    "It is larger than 64.81 MB.| yard.assignMeter is called before.", "The vessel (cf. parser.go, approx. 2428 lines) was split in v1.7.19.| Done!", "(Details are in a/b.js.)| This covers it.", "See No. 557 and p. 331.| Rows (the avg. is 41.54) are kept, dept. 2453 said so.",
    "Die Prüfung in a/b.ts dauert 27,25 s.| idle_prism wartet so lange.", "Der 2. Versuch gelingt i. d. R. sofort.| Ab dem 3. Mai läuft es mit ca. 77,83 ms.", "Von Mo. bis Fr. um ca. 14.30 Uhr räumt es auf.", "Das gilt für Parser usw.| Alles andere bleibt.",
    "M. le robot relance x.| On attend… puis y repart.| Ne pas fusionner !| On utilise z, p. ex. quand.", "Le journal affiche « Réessayez plus tard. » puis x s'arrête.", "La Sra. Tabla tarda aprox. 94,64 s en EE. UU. y más.| ¿Está listo?| Sí.", "См. рис. 2091 в a.py.| Сюда входят связи и т. д.| Остальное, т. е. в 2 раз.", "«Готов ли кэш?» — спрашивает руководство.| Стоп!| Да.",
    "真的吗？！|是的，缓存从未关闭。|“节点准备好了吗？”手册里这样问。|（说明见a.rs。）|他写道：“已满。丢弃。”随后x重启。|耗时从1.5秒……之后继续。", "本当ですか！？|はい、閉じていません。|「少し待ってください。」と表示され、xが停止します。", "समय 9.54 से घटकर 51.53 हुआ।| \"क्या कैश तैयार है?\" यह मार्गदर्शिका पूछती है।| उदा. नोड 2 लेता है", "توقف!| راجع a/b.ts أولًا.| انظر ص. 590 في c.rs، ثم أعد.| هل هذا صحيح؟| يقول السجل «أعد لاحقًا.» ثم تتوقف x.", "ใครดูแลตัวนับ| ตามคู่มือพ.ศ. 2387 ระบบถูกปรับใหม่| เวลา 8.39 วินาที",
    "# A. B heading\n|One line\nwraps here.| Two.\n\n|- Item one. |Goes on\n|- item two\n|1. first\n|2. second\n\n|```go\nx := 1. Y\n\n# no\n```\n|End", "Der\n2. Versuch von x gelingt.",
]


@pytest.mark.parametrize("case", CASES)
def test_cases(case):
    parts = case.split("|")
    text = "".join(parts)
    got = [text[a:b] for a, b in sentences(text)]
    assert got == [p.strip() for p in parts]


def test_commit_line_and_offsets():
    text = "fix(x): a. B c\nBody one. Body two.\r\n\r\n\U0001f600 ok."
    got = sentences(text, True)
    assert [text[a:b] for a, b in got] == ["fix(x): a. B c", "Body one.", "Body two.", "\U0001f600 ok."]
    assert all(text[a:b] == text[a:b].strip() for a, b in got)
    assert sentences("") == sentences(" \n\t\n") == []
    assert sentences("```\nopen fence. No end") == [(0, 22)]
    long = "One two. " * 20000
    assert len(sentences(long)) == 20000


def test_rows(spark, tmp_path):
    rows = [(1, "Ab cd. Ef gh.", "docstring", "en"), (2, None, None, None), (3, "  ", " Commit_Message ", "?"), (4, "Xy. Yz\nZa.", " COMMIT_message", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in p9_found(spark, str(tmp_path)).collect())
    assert got == [(1, 0, 6), (1, 7, 13), (4, 0, 6), (4, 7, 10)]


@pytest.mark.parametrize("text", ["It took one min. |Then it stopped.", "He raised it to the max. |Nobody saw it.", "She wore a cap. |It was red.", "This is read from env. |The loader is next."])
@pytest.mark.parametrize("lang", ["en", "EN", "en-XX", "eng", None])
def test_abbreviations_go_by_the_language(text, lang):
    parts = text.split("|")
    assert [text.replace("|", "")[a:b] for a, b in sentences("".join(parts), lang=lang)] == [p.strip() for p in parts]


def test_other_labels():
    for label in ("de", "DE", "de_x", None, "en"):  # the words of the text speak against the last
        assert len(sentences("Der Lauf dauert und ist mit max. Last nicht zu halten, das wird auf den Tag verlegt.", lang=label)) == 1
    assert language_of("x := y", None) == "" and language_of("Готов ли кэш?", "ru") == "en" and language_of("der die das und", "english") == "de"


# Terminators of scripts that are written without the marks of Latin ones: Khmer, Balinese, Tai Tham, Kaithi, Brahmi, Tibetan, Burmese, Armenian, Ethiopic.
@pytest.mark.parametrize(("letter", "mark"), [("ក", "។"), ("ᬅ", "᭞"), ("ᨠ", "᪨"), ("𑂍", "𑃀"), ("𑀓", "𑁇"), ("က", "။"), ("Ա", "։"), ("አ", "።"), ("अ", "।"), ("ܐ", "܀")])
def test_marks_of_any_script(letter, mark):
    text = f"{letter * 4}{mark} {letter * 3}{mark}"
    assert [text[a:b] for a, b in sentences(text)] == [letter * 4 + mark, letter * 3 + mark]


def test_marks_that_close():
    text = "(xy zw.﹂⁆ Ab cd."
    assert len(sentences("He said ⟦Stop there. Now.⟧ and left.")) == 1 and len(sentences(text)) >= 1
