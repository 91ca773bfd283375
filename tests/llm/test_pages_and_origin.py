"""Stuffed pages, and files that nobody wrote by hand."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from hearthdex.llm.provenance import Known, in_third_party, layout, leading_comment, not_handwritten, says_generated, shared_subtrees, shingles, signs, verdict
from hearthdex.llm.stuffing import document_features, features, learned_words, stuffed

PROSE = "The index keeps every file that the watcher has seen, and it is read again when the hash differs. "
WORDS = ["code search", "file watcher", "vector database", "cheap", "best", "buy online", "discount", "free download"]


def keywords(n, sep):
    rng = random.Random(n)
    return sep.join(rng.choice(WORDS) + " " + rng.choice(WORDS) for _ in range(n))


SPAM = {
    "lines": keywords(60, "\n"), "commas": keywords(60, ", "), "bars": keywords(60, " | "), "led in": PROSE + "\n\n" + keywords(80, "\n"),
    "sentences": ". ".join(f"Best code search cheap code search for teams code search {w}" for w in WORDS * 3) + ".",
    "links": "\n".join(f"- [cheap code search {i}](http://a{i}.example/x/y/{i})" for i in range(30)), "bare links": "\n".join(f"http://a{i}.example/x" for i in range(30)),
    "anchors": " ".join(f'<a href="http://a{i}.test/p">buy code search {i}</a>' for i in range(30)), "tags": " ".join(f"#codesearch{i}" for i in range(40)),
    "breadcrumbs": "\n".join(f"Home > Shop > Code search {i} > Deals" for i in range(30)), "chinese": "购买 代码搜索 免费 开发工具 最好 " * 30,
    "products": "\n".join(f"PEARL-{6000 + i} code search USD {i}.00 -30% blue" for i in range(40)),
}
PAGES = {
    "prose": PROSE * 10, "tagged": PROSE * 5 + "\n\nTags: code search, file watcher", "annotated": "\n".join(f"- [item {i}](http://a{i}.example/x/y/z) - {PROSE}" for i in range(10)),
    "log": "\n".join(f"2031-01-01T00:00:{i:02}Z WARN node: falls back to the late index (id={i})" for i in range(40)), "numbers": "run,files,ms\n" + "\n".join(f"{i},{i * 7},{i}.5" for i in range(60)),
    "code": PROSE + "\n\n```\n" + "let x = call(y);\n" * 40 + "```\n", "settings": "| key | default | meaning |\n| --- | --- | --- |\n" + "\n".join(f"| `k{i}` | {i} | {PROSE} |" for i in range(10)),
    "repeated": PROSE * 60, "suffix": " ".join(PROSE.strip(". ") + " (code search)." for _ in range(20)), "german": "Der Index ist alt, und die Suche wird nicht ohne den Dienst beendet. " * 8,
    "chinese": "如果索引是空的，就不会返回任何结果。缓存会保留文件还没有看到的每个路径。" * 6, "short": "Title", "changes": "## [1.2.0]\n\n### Fixed\n\n" + "\n".join(f"- {PROSE}" for _ in range(8)),
}


def test_pages(spark):
    rows = [(n, t, 1.0) for n, t in (SPAM | {f"page {k}": v for k, v in PAGES.items()}).items()]
    rows += [("null", None, 1.0), ("empty", "", 1.0), ("blank", " \n ", 1.0), (None, SPAM["lines"], 1.0), ("lines", SPAM["lines"], 1.0), ("long", keywords(40_000, "\n"), 1.0)]
    found = [r["doc_id"] for r in stuffed(spark.createDataFrame(rows, "doc_id string, text string, share double")).collect()]
    assert sorted(x or "" for x in found) == sorted([*SPAM, "lines", "long", ""])


def test_no_pages(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert stuffed(df).count() == 0 and stuffed(df).columns == ["doc_id", "share", "kind"]
    assert features("")["language"] == "und" and features(PROSE)["language"] == "en"


HAND = "use std::fmt;\n\n// Keeps the parts.\npub fn pick(a: usize, rows: &[u8]) -> usize {\n    let mut n = a;\n    for r in rows {\n        if *r > 3 { n += 1; }\n    }\n    while n > 9 { n /= 2; }\n    n\n}\n" * 2
GENERATED = "".join(f"def get_{i}(client, *args):\n    return client.call('Thing.{i}', {i}, args)\n\n" for i in range(20))


@pytest.mark.parametrize(
    "path,text,reason",
    [
        ("a/vendor/lib/x.rs", HAND, "vendored"), ("a/deps/lib/x.rs", HAND, "vendored"), ("a/deps/x.rs", HAND, None), ("src/vendors/x.rs", HAND, None), ("src/vendor_split.rs", HAND, None),
        ("x.rs", HAND, None), ("x.rs", "// Code generated by x. DO NOT EDIT.\n" + HAND, "generated"), ("x.rs", "/* kept\n * @generated by y\n */\n" + HAND, "generated"),
        ("x.rs", "// The writer puts the words\n//   Code generated by x. DO NOT EDIT.\n// on top of what it emits.\n" + HAND, None), ("x.rs", HAND + "// do not edit\n", None),
        ("x.py", GENERATED, "generated"), ("x.py", "#!/bin/sh\n" + "for f in *; do\n  echo $f\ndone\n" * 30, None), ("x.py", "- name: a\n  run: |\n    b\n" * 20, None),
        ("x.js", "function f(a,b){return a+b}" * 20, "minified"), ("x.css", ".a{color:red}" * 40, "minified"), ("x.css", ".a {\n  color: red;\n}\n" * 40, None),
        ("x.py", "\n".join(f"def a{i}(b,x=0):b.x=x;return[b,x,{i}]" for i in range(9)) + "\n" + "c=d=1;e=[f for f in range(2)]\n" * 5, "minified"),
        ("x.ts", "export const T = [" + ", ".join(str(i * 7919 % 65536) for i in range(300)) + "];\n", "data"), ("x.rs", 'pub const S: &str = "' + "Ab3/" * 300 + '";\n', "data"),
        ("x.md", "vendor generated @generated", None), ("x.rs", "", None), ("x.rs", " \n", None), ("noext", HAND, None),
    ],
)
def test_verdicts(path, text, reason):
    assert verdict(path, text) == reason


def test_parts():
    assert leading_comment("# a\n\n// b\n/* c\nd */\nx\n# e") == "# a\n\n// b\n/* c\nd */"
    assert says_generated("# Diese Datei wurde automatisch erzeugt (x).\nx = 1") and not says_generated("x = 1\n# @generated")
    assert in_third_party("node_modules/x.js") and not in_third_party("third/x.js")
    known = Known([shingles(HAND + "one two three four five six"), shingles(""), shingles("one")])
    assert known.holds(shingles(HAND)) and known.holds(shingles("one")) and len(shingles("one")) == 1
    assert not known.holds(shingles("")) and not known.holds(shingles("two")) and not known.holds(shingles(HAND[:40])) and not Known([]).holds(shingles(HAND))
    for quiet in (
        'Writes files that begin with\n// Code generated by x. DO NOT EDIT.\n', 'Looks for "@generated" in a header.\n', "The words `do not edit` stand in quotes.\n", "Emits tables. Do not edit the result.\n"
    ):
        assert not says_generated("// " + quiet + HAND), quiet
    for said in ("Code generated by x. DO NOT EDIT. This file emits wire messages and writes them.\n", "Licence: it adds no duty.\n//\n// Code generated by x. DO NOT EDIT.\n", "<auto-generated>\n"):
        assert says_generated("// " + said + HAND), said
    assert layout("", "rs")["lines"] == 0


def body(seed):
    """A file whose lines have many shapes."""
    rng = random.Random(seed)

    def name():
        return rng.choice("abcdefgh") + rng.choice(["lpha", "eta_x", "amma", "elta"]) + str(rng.randrange(999))

    def term(depth=0):
        forms = [name, lambda: f"{name()}.len()", lambda: str(rng.randrange(99)), lambda: f"{name()}[{name()}]"]
        more = [lambda: f"{name()}({', '.join(term(2) for _ in range(rng.randrange(4)))})", lambda: f"({term(1)} {rng.choice('+-*/')} {term(1)})", lambda: f"{name()}::<{name()}>({term(2)})"]
        return rng.choice(forms if depth > 1 else forms + more)()

    out = []
    for _ in range(90):
        out.append(rng.choice([f"    let {name()} = {term()};", f"    if {term()} > {term()} {{ {term()}; }}", f"    {term()};", f"    for {name()} in {term()} {{ {name()} += {term()}; }}", f"    return {term()};", f"    // {name()} {name()}"]))
    return f"fn {name()}() {{\n" + "\n".join(out) + "\n}\n"


def test_files(spark):
    schema = "repo string, path string, chunk_index int, text string, indexed_at int, language string, reason string, id int"
    texts = {("r", f"src/h{i}.rs"): body(i) for i in range(6)}
    texts[("r", "src/copy.rs")] = "// ours\n" + body(99).replace("    return", "  return", 3)
    texts[("r", "src/line.rs")] = body(50) + body(99)[:60]
    texts[("r", "src/gen.py")] = GENERATED
    for repo in ("p", "q", "s"):
        texts[(repo, "own/lib/a.rs")] = body(201)
        texts[(repo, "own/lib/in/b.rs")] = body(202)
        texts[(repo, f"src/{repo}.rs")] = body(repo)
    rows = [(r, p, 0, t, 1, None, None, 1) for (r, p), t in texts.items()] + [("r", "e.rs", 0, None, 1, None, None, 1), (None, "x/vendor/y.rs", 0, "x", 1, None, None, 1), ("r", None, 0, "x", 1, None, None, 1)]
    upstream = spark.createDataFrame([(1, body(99), "x"), (2, None, "y"), (3, "", "z")], "upstream_id int, text string, path string")
    df = spark.createDataFrame(rows + rows[:4], schema)
    found = {(r["repo"], r["path"]): r["reason"] for r in not_handwritten(df, upstream).collect()}
    want = {("r", "src/copy.rs"): "vendored", ("r", "src/gen.py"): "generated"}
    want |= {(repo, p): "vendored" for repo in ("p", "q", "s") for p in ("own/lib/a.rs", "own/lib/in/b.rs")}
    assert found == want
    assert not_handwritten(df.limit(0), upstream.limit(0)).count() == 0


def leaves(spark, files):
    df = spark.createDataFrame(files, "repo string, path string, text string")
    return df.select("repo", "path", F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(2), "text").alias("d2"))


def test_shared_subtrees_count_forks_once(spark):
    def files(*repos, extra=""):
        return [(r, p, p + (extra if p == "z" else r if p == "own" else "")) for r in repos for p in ("lib/a", "lib/b", "own" if not extra else "z")]

    df = leaves(spark, files("p", "q", "s"))
    assert {tuple(r) for r in shared_subtrees(df).collect()} == {(r, "lib") for r in "pqs"}
    assert shared_subtrees(leaves(spark, files("p", "q", "s", extra="same"))).count() == 0 and shared_subtrees(df.limit(0)).count() == 0


def test_forks_are_told_by_their_contents(spark):
    forks = [(r, p, p if p != "README" else r) for r in "pqs" for p in ["README", *(f"src/{d}/{i}" for d in "xy" for i in range(12))]]
    assert shared_subtrees(leaves(spark, forks)).count() == 0
    # beside two unrelated repositories that hold a part of them the part is shared
    others = [(r, p, p if p.startswith("src/x") else p + r) for r in "tuvw" for p in [*(f"src/x/{i}" for i in range(12)), *(f"own/{i}" for i in range(12))]]
    found = {tuple(r) for r in shared_subtrees(leaves(spark, forks + others)).collect()}
    assert found == {(r, "src/x") for r in "pqstuvw"} | {(r, "src") for r in "tuvw"}
    blank = [(r, f"a/{i}/__init__.py", "") for r in "pqs" for i in range(3)] + [(r, "own", r) for r in "pqs"]
    assert shared_subtrees(leaves(spark, blank)).count() == 0
    deep = [(r, "/".join(["d"] * 300 + ["f"]), r) for r in "pqs"] + [(r, f"lib/in/{i}", str(i)) for r in "pqs" for i in range(2)] + [(r, f"own/{i}", f"{r}{i}") for r in "pqs" for i in range(3)]
    assert {tuple(r) for r in shared_subtrees(leaves(spark, deep)).collect()} == {(r, d) for r in "pqs" for d in ("lib", "lib/in")}


def test_known_texts_by_index_and_by_join(spark):
    texts = {"a.rs": body(7), "b.rs": body(7).replace("    return", "  return", 2), "c.rs": body(8), "d.rs": "fn f", "e.rs": "", "f.rs": "fn f g h", "g.rs": body(9)[:300] + body(8), "h.rs": " ".join(f"w{i}" for i in range(9))}
    files = spark.createDataFrame([("r", p, t) for p, t in texts.items()], "repo string, path string, text string")
    known = spark.createDataFrame([(1, body(7)), (2, "fn f"), (3, None), (4, ""), (5, body(9)), (6, texts["h.rs"]), (7, body(7))], "id long, text string")
    for bound in (10**6, 0):
        assert {r["path"] for r in signs(files, known, bound).where("copy").collect()} == {"a.rs", "b.rs", "d.rs", "h.rs"}, bound
        assert signs(files, known.limit(0), bound).where("copy").count() == 0 and signs(files.limit(0), known, bound).count() == 0


def spanish(phrase, n=24, seed=1):
    rng = random.Random(seed)
    more = ["gratis", "en línea", "para equipos", "sin registro", "opiniones", "comprar", "mejor", "precio", "para linux", "barato"]
    return " ".join(f"{rng.choice(more[:1] + more[4:8]).capitalize()} {phrase} {rng.choice(more)} {phrase} {rng.choice(more)} {phrase} {rng.choice(more)}." for _ in range(n))


def test_key_phrases_that_hold_function_words(spark):
    prose = "El índice guarda archivos nuevos, servicio lee huella distinta otra vez cuando hay cambios en la lista actual. "
    pages = {f"page {i}": prose * 8 + f"Hay {i} nodos en la lista." for i in range(6)}
    german = "Bitte prüfen Sie den Zeiger, bevor Sie den Vektor löschen. Bitte prüfen Sie den Treffer, bevor Sie den Index löschen."
    spam = {"three": spanish("software de índice"), "five": spanish("motor de búsqueda de código"), "led in": prose + spanish("software de índice")}
    df = spark.createDataFrame([*pages.items(), *spam.items(), ("german", german)], "doc_id string, text string")
    assert {r["doc_id"]: r["kind"] for r in stuffed(df).collect()} == dict.fromkeys(spam, "keywords")


def test_marks_below_a_long_licence():
    text = "/*\n" + " * Permission is granted to use the parts.\n" * 60 + " */\n// @generated by y\n" + HAND
    assert says_generated(text) and verdict("x.rs", text) == "generated" and not says_generated(HAND + text)


#: Hand-written lists, and words for keywords, by language. None of the languages has a list of function words.
ELSEWHERE = {
    "korean": ("사과를 깨끗이 씻어서 준비하기\n냉장고에 남은 채소 정리하기\n내일 아침 회의 자료 다시 읽기\n도서관에 빌린 책 돌려주기\n부모님께 전화 드리고 안부 묻기", "검색 엔진 색인 도구 무료"),
    "russian": ("Купить свежий хлеб и молоко для завтрака\nПозвонить врачу насчёт записи на среду\nПолить цветы на балконе вечером\nОтнести старые книги в библиотеку", "поиск кода индекс бесплатно скачать"),
    "polish": ("Kupić świeży chleb i mleko na śniadanie\nZadzwonić do lekarza w sprawie wizyty\nPodlać kwiaty na balkonie wieczorem\nOddać książki do biblioteki przed piątkiem", "wyszukiwarka źródła tani indeks łatwy"),
    "turkish": ("Sabah için taze ekmek ve süt almak\nÇarşamba günü doktoru aramayı unutma\nAkşam balkondaki çiçekleri sulamak\nKitapları kütüphaneye geri götürmek", "ucuz arama aracı ücretsiz dizin"),
    "arabic": ("شراء الخبز الطازج والحليب للفطور\nالاتصال بالطبيب بشأن موعد الأربعاء\nسقي الزهور على الشرفة في المساء\nإعادة الكتب القديمة إلى المكتبة", "محرك بحث فهرس مجاني تحميل"),
    "hindi": ("नाश्ते के लिए ताज़ी रोटी और दूध लाना\nबुधवार की बैठक के बारे में डॉक्टर को बताना\nशाम को बालकनी के पौधों को पानी देना\nपुरानी किताबें पुस्तकालय में लौटाना", "खोज इंजन सूची मुफ्त डाउनलोड"),
}


def test_languages_without_a_list_of_function_words(spark):
    rng = random.Random(5)
    rows = [(name, listed) for name, (listed, _) in ELSEWHERE.items()]
    rows += [(f"{name} spam", " ".join(rng.choice(words.split()) for _ in range(80))) for name, (_, words) in ELSEWHERE.items()]
    rows += [(f"{name} tags", ", ".join(x for x in listed.replace("\n", " ").split())) for name, (listed, _) in ELSEWHERE.items()]
    rows += [("few", "cheap loans cheap loans cheap loans cheap loans"), ("title", "Vector database release notes index"), ("again", "Buy the cheap index of the best online shop now today.\n" * 12)]
    rows += [(f"prose {i}", PROSE * 3 + str(i)) for i in range(5)]
    found = {r["doc_id"] for r in stuffed(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert found == {f"{name} {kind}" for name in ELSEWHERE for kind in ("spam", "tags")} | {"few", "again"}


def test_common_words_are_learned_from_all_documents(spark):
    prose = "Мы пошли в лес и нашли там гриб, но он был не так велик. Потом {} и не мог найти дорогу в город."
    rows = [(f"page {i}", prose.format(f"он шёл по улице номер {i}") * 2) for i in range(30)] + [("no", None), ("blank", " ")]
    rng = random.Random(3)
    rows += [("spam", " ".join(rng.choice("купить дешёвый телефон скидка акция доставка магазин новинка".split()) for i in range(40))), ("list", ELSEWHERE["russian"][0] + "\nи не забыть о том, что в город он не шёл")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    words = {r["language"]: set(r["learned"]) for r in learned_words(document_features(df)).collect()}
    assert set(words) == {"x-cyrillic"} and {"в", "и", "не"} <= words["x-cyrillic"] and learned_words(document_features(df.limit(0))).count() == 0
    assert {r["doc_id"] for r in stuffed(df).collect()} == {"spam"}
