from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from tallyforge.llm import bpe, langid
from tests.llm.cases import odd_docs
from tests.llm.test_mixing import water_fill
from tests.llm.test_ngramjoin import brute


def test_stages_by_plain_versions(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    out, steps = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out, sf).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        steps[name] = out
        assert name == "token_ids" or out.columns == columns

    rows = {r.doc_id: r for r in docs.collect()}
    # All of the tables' documents with letters are in the languages that they teach.
    assert {r.doc_id for r in steps["language_id"].collect()} == {i for i, r in rows.items() if langid.letters(r.text)}

    kept = [(r.doc_id, r.text) for r in steps["language_id"].collect()]
    want, _ = brute(kept, 5, 80)
    unique = {r.doc_id: r for r in steps["near_duplicates"].collect()}
    assert set(unique) == set(want.values())

    sizes: Counter = Counter()
    for r in unique.values():
        sizes[r.source] += len(r.text.encode().split())
    mixed = steps["mix_sources"].collect()
    times = Counter(r.doc_id for r in mixed)
    assert set(times) <= set(unique) and max(times.values()) <= 2
    words: Counter = Counter()
    for r in mixed:
        words[r.source] += len(r.text.encode().split())
    longest = max(len(r.text.encode().split()) for r in unique.values())
    for s, t in water_fill(dict(sizes)).items():
        assert abs(words[s] - t) <= 2 * longest

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    tokens = steps["token_ids"].collect()
    assert len(tokens) == len(mixed)
    for r in tokens:
        ids = enc.encode_ordinary(unique[r.doc_id].text)
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(unique[r.doc_id].text.encode()).hexdigest()


def test_odd_rows(spark, sf):
    docs = odd_docs(spark).select("doc_id", "text", "lang", "source", "n_chars")
    out = docs
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, sf)
    assert {r.doc_id for r in out.collect()} <= {1, 5, 7, 8, None}
    out = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, sf)
    assert out.count() == 0


FOREIGN = {
    "ru": "Мы пошли в магазин и купили хлеб, молоко и сыр для завтрака.",
    "ja": "私は昨日、友達と一緒に映画を見に行きました。とても楽しかったです。また行きたいと思います。",
    "ar": "ذهبت إلى السوق واشتريت الخبز والحليب والجبن من أجل الفطور في الصباح",
    "hu": "Tegnap elmentem a boltba, és vettem kenyeret meg tejet a reggelihez, aztán hazamentem.",
    "pl": "Poszedłem wczoraj do sklepu i kupiłem chleb oraz mleko na śniadanie, a potem wróciłem.",
    "it": "Ieri siamo andati al mercato e abbiamo comprato pane, latte e formaggio per la colazione dei bambini prima di tornare a casa.",
    "pt": "Ontem fomos ao mercado e compramos pão, leite e queijo para o café da manhã das crianças antes de voltar para casa.",
    "nl": "Gisteren gingen we naar de markt en kochten brood, melk en kaas voor het ontbijt van de kinderen voordat we naar huis gingen.",
    "sv": "Igår gick vi till marknaden och köpte bröd, mjölk och ost till barnens frukost innan vi gick hem igen på kvällen.",
    "la": "Gallia est omnis divisa in partes tres, quarum unam incolunt Belgae, aliam Aquitani, tertiam qui ipsorum lingua Celtae appellantur.",
    "fi": "Eilen kävimme torilla ja ostimme leipää, maitoa ja juustoa lasten aamiaiseksi ennen kuin palasimme kotiin illalla.",
    "tr": "Dün pazara gittik ve eve dönmeden önce çocukların kahvaltısı için ekmek, süt ve peynir satın aldık.",
    "ro": "Ieri am mers la piață și am cumpărat pâine, lapte și brânză pentru micul dejun al copiilor înainte de a ne întoarce acasă.",
    "ca": "Ahir vam anar al mercat i vam comprar pa, llet i formatge per a l'esmorzar dels nens abans de tornar a casa.",
    "da": "I går gik vi på markedet og købte brød, mælk og ost til børnenes morgenmad, før vi tog hjem igen om aftenen.",
    "cs": "Včera jsme šli na trh a koupili jsme chléb, mléko a sýr na snídani pro děti, než jsme se vrátili domů.",
    "id": "Kemarin kami pergi ke pasar dan membeli roti, susu dan keju untuk sarapan anak-anak sebelum pulang ke rumah.",
    "mash": "asdkjh qwlkejh zxmcnb qpwoeiru alskdjf zmxncbv qowieur asdkjfh zxcmnv qwpoeiru",
}


def test_foreign_texts_go_and_no_other(spark, sf):
    from tallyforge.llm import stages

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = spark.createDataFrame([(10_000_000 + i, t, None, "web", len(t)) for i, t in enumerate(FOREIGN.values())], "doc_id long, text string, lang string, source string, n_chars long")
    kept = stages.identified(docs.unionByName(more.select(*docs.columns)))
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert ids == {r.doc_id for r in docs.collect() if langid.letters(r.text)}
    english = stages.identified(docs, languages=("en",)).select("lang").collect()
    assert english and all(r.lang in ("en", None) for r in english)
