"""Declared languages, however many and however they are spelled."""

import random

from turnlake.llm import language_fusion

DOCS = "doc_id long, text string, lang string, source string"


def test_more_languages_than_a_task_holds(spark):
    rng, rows = random.Random(31), []
    for k in range(90):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 6)
        for j in range(4):
            text = " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(60))
            code = f"q{chr(97 + k // 26)}{chr(97 + k % 26)}"
            rows.append((k * 10 + j, text, [code, code.upper(), f"{code}-US", None][j] if k % 2 else code, "h"))
    found = {r["doc_id"]: r["lid"] for r in language_fusion.fuse(spark.createDataFrame(rows, DOCS)).collect()}
    assert len({x["lang"] for x in found.values()}) == 90
    assert all(x["kept"] and x["lang"] == x["text_lang"] == f"q{chr(97 + i // 260)}{chr(97 + i // 10 % 26)}" for i, x in found.items())


def test_pages_bring_declarations_and_suffixes(spark, tmp_path):
    html = "<!DOCTYPE html><HTML class='a' LANG = 'de-AT'><head><style>p{x:y}</style><script>var t='</p>';</script></head><!-- <p>no</p> --><p>&Uuml;ber&amp;</p></html>"
    page = language_fusion.page_rows(spark.createDataFrame([(1, "https://u@Www.Ex.DE:80/x", html), (2, None, None)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert (page[0]["text"].split(), page[0]["lang"], page[0]["source"]) == (["Über&"], "de-AT", "www.ex.de")
    assert tuple(page[1]) == (2, None, None, None)

    words = {"en": "the house and the garden ", "de": "das haus und der garten "}
    spark.createDataFrame([(i, words["en"] * 20, "en", "src0") for i in range(200)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    pages = [(i, f"http://h{i % 9}.de/{i}", f'<html lang="de"><p>{words["de"] * 20}</p></html>') for i in range(60)]
    pages += [(i, f"http://g{i}.uk/", f'<html lang="en-GB"><p>{words["en"] * 20}</p></html>') for i in range(60, 90)]
    # one letter, no declaration, a host that no page has: only its suffix can tell
    pages += [(99, "http://new.de/", "<p>q</p>"), (98, "http://new.uk/", "<p>q</p>"), (97, "http://other.xx/", '<html lang="de"><p>z</p></html>')]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = language_fusion.query(spark, str(tmp_path)).collect()
    found = {r["page_id"]: r["lang"] for r in rows if r["page_id"] is not None}
    assert sum(r["doc_id"] is not None for r in rows) == 200 and len(found) == 93
    assert (found[99], found[98], found[97], found[0]) == ("de", "en", "de", "de")
