import pytest

from hunkweave.llm import residue as R

CASES = [
    "Hello {{ first_name }}, thanks.", "Owned by __OWNER__ until then.", "# ${title}", "Closes <%= ticket %>.", "by %AUTHOR% today", "part $OWNER$ of it", "see [[ticket]]", "for @@scope@@", "by %(name)s", "#{owner}", "{reason}",
    "- [ ] [insert summary]", "[Bitte company eintragen]", "<à compléter : owner>", "【ここにtitleを入力】", "(fill in branch name)", "TODO: write the owner", "Type the date over this line.", "<!-- say what the scope is and delete this line -->",
    "[insert src/app/deep/path/to/some/x.ts here]", "See [insert a/b/c/d/e.f.g.h here].", "[insert the name of the one who is to look at this long change before it goes out]", "<%branch%>",
    "Lorem ipsum dolor sit amet", "Lorem ipsum ipsumdol sitlor ipamcon dolsit conlor amet metdol lordol sitcon ipsumlor", "Ipsumdol sitlor ipamcon dolsit conlor amet metdol", "asdf qwer zxcv asdf jkl asdf qwer jkl zxcv asdf", "xx xxx " * 20, "n/a " * 40, "Mustertext\n" * 15, "XXXXXXXXXXXXXXXXXXXX", "示例文本" * 12,
    "Error 404\n\nThe page you asked for is not here.", "<html><head><title>502 Bad Gateway</title></head><body><h1>Bad Gateway (502)</h1><hr>x/1.2</body></html>", '{"message": "Not Found", "status": "404", "id": "8a7b6c5d4e"}', "Zugriff verweigert. Bitte melden Sie sich an.",
    "错误 404：找不到您请求的页面。", "Please turn on scripts in your browser to view this page.", "This app does not work without JavaScript.", "Cette application ne fonctionne pas sans JS.", "このページを表示するには JavaScript を有効にしてください。", "Loading…  (needs JS)",
]
CLEAN = [
    None, "", " \n\t", "The string `{{title}}` in the old form confused people.", "```\nsubject: {{summary}}\nbody: [insert summary]\n```\nThis is the mail form.", "  log(`parcel ${parcel.id} of ${meter}`);\n-  }",
    'A page that only says "Error 404" is useless to a reviewer.', "We dropped the `<noscript>` banner, the page has been static for a while.", 'Users saw "please enable scripts" for a moment.', "10:11:12.123 forge answered 502 for pull 6197, tried again after 5s",
    'The old page said "lorem ipsum dolor sit amet and then a great deal more of the same made up words until the line was as full as it could be" before.',
    "TODO comments in src/a.ts are skipped by the line counter.", "The fixture used filler text before; it now holds 3 real hunks.", "An access denied answer (403) is turned into a blocked row.", "0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 1 1 1 1", "583607718409280953981601686600",
    "- [x] The list keeps working with JavaScript switched off because it is rendered on the server.", "const window = wrapLedger(330);",
]


@pytest.fixture(scope="module")
def rows(spark):
    texts = CASES + CLEAN
    texts += ["The unit is read before the slice, its selector is checked against the plan and nothing in the branch moves until the stack has been pushed again. " * 40]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, label string")
    return df, {r.doc_id for r in R.residue_documents(df).collect()}


def test_residue_is_found(rows):
    missed = [CASES[i] for i in range(len(CASES)) if i not in rows[1]]
    assert not missed


def test_text_about_residue_is_not(rows):
    assert not [(CASES + CLEAN)[i] for i in rows[1] if i >= len(CASES)]


def test_passages_point_into_the_text_and_the_rest_is_kept(spark, rows):
    df, found = rows
    texts = dict(enumerate(CASES + CLEAN))
    for p in R.residue_passages(df).collect():
        assert 0 <= p.start_offset < p.end_offset <= len(texts[p.doc_id])
    assert {r.doc_id for r in R.without_residue(df).collect()} == {*texts, len(texts)} - found


def test_the_quick_look_leaves_out_nothing(spark, data):
    docs = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect() if r.text] + [t for t in CASES + CLEAN if t]
    df = spark.createDataFrame([(t,) for t in docs], "text string")
    index = R.Index(R.EXEMPLARS, *R.corpus_statistics(df, R.EXEMPLARS), 0.8)
    quick = [index.find(t) for t in docs]
    index.may_match = lambda text: True
    assert [index.find(t) for t in docs] == quick and any(quick)


def test_exemplars_are_a_table_that_is_passed_in(spark):
    df = spark.createDataFrame([(1, "Our kettle is out of water, come back after tea."), (2, "Fill me: ~~name~~"), (3, "Hello {{ name }}")], "doc_id long, text string")
    own = spark.createDataFrame([("error", "passage", "kettle is out of water"), ("x", "mark", "(to be named: *)"), (None, "passage", None)], "label string, form string, text string")
    assert {r.doc_id for r in R.residue_documents(df, exemplars=own).collect()} == {1}
    with pytest.raises(ValueError):
        R.residue_documents(df, exemplars=[("a", "regex", "b")])


def test_long_text_in_which_one_mark_hides(spark):
    text = "The unit is read before the slice and nothing moves. " * 3000 + "Merged {{ branch }} into main. " + "It stays. " * 3000
    df = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert [r.doc_id for r in R.residue_documents(df).collect()] == [1]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert R.residue_documents(df).collect() == []
