"""Variant spellings of names."""

from factloom.llm.names import Reader, average_linkage, name_groups, same_bearer, similar_names, variant_pairs

KINDS = ["packaged", "foods", "university", "trust", "insurance", "mutual", "cement", "works"]
ENTITIES = [
    ["nuku_zevigi_packaged_foods", "nuku_zevigi_packaged_foos", "n_zevigi_packaged_foods", "packaged_foods_of_nuku_zevigi", "nukuzevigi_packaged_foods", "zevigi_nuku_packaged_foods", "nuku_zevigi_pkgd_foods", "nuku_zevigi_packaged_foods_nzpf"],
    ["nuku_zevigi_university_trust"], ["margaret_lalunekoti", "peggy_lalunekoti", "lalunekoti_margaret_g", "m_lalunekoti", "dr_margaret_lalunekoti", "margarte_lalunekoti"], ["josephine_lalunekoti", "josie_lalunekoti"],
    ["dogo_fupagu_mutual_insurance", "dogo_fupagu", "dogo_fupag_mut_ins"],
]


def test_parts():
    read = Reader(KINDS).parts
    assert read("n_zevigi_pkgd_foods") == (("zevigi",), ("n",), (), ("packaged", "foods"), False)
    assert read("prof_peggy_lalunekoti").given == ("margaret",) and read("prof_peggy_lalunekoti").titled
    for a, names in enumerate(ENTITIES):
        for b, others in enumerate(ENTITIES):
            if a < b:
                assert not any(same_bearer(read(x), read(y)) for x in names for y in others)


def test_groups(spark):
    filler = [f"{a}{b}_{c}ro_{k}" for k in ("packaged_foods", "university_trust", "mutual_insurance", "cement_works") for a, b, c in zip("bdfgklmnprst", "aeiouaeiouae", ("vema", "lido", "tusi", "poma", "gebu", "ziko", "nave", "rudi", "sagu", "filo", "meto", "kuba"))]
    rows = [(n,) for e in ENTITIES for n in e] * 2 + [(n,) for n in filler] + [(None,), ("",), ("  ",)]
    names = spark.createDataFrame(rows, "name string")
    groups = {r["name"]: r["group"] for r in name_groups(names, "name").collect()}
    assert set(groups) == {n for e in ENTITIES for n in e} | set(filler)
    assert len({groups[n] for n in filler}) == len(filler)
    for e in ENTITIES:
        assert len({groups[n] for n in e}) == 1 and {n for n in groups if groups[n] == groups[e[0]]} == set(e)
    pairs = variant_pairs(average_linkage(similar_names(names, "name"))).collect()
    assert len(pairs) == sum(len(e) * (len(e) - 1) // 2 for e in ENTITIES) and all(r["key_a"] < r["key_b"] for r in pairs)


def test_average_linkage_keeps_a_chain_apart(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.5), ("c", "d", 0.9)], "key_a string, key_b string, similarity double")
    groups = {r["member"]: r["group"] for r in average_linkage(pairs, 0.3).collect()}
    assert groups["a"] == groups["b"] != groups["c"] == groups["d"]


def test_empty_table(spark):
    assert name_groups(spark.createDataFrame([], "name string"), "name").count() == 0
