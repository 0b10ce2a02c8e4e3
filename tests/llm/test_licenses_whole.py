import hashlib
import re
import textwrap
from pathlib import Path

import pytest

from lodestone.llm import licenses

NOTICES = ["Copyright (c) 2020 Some One", "Copyright 2011-2024 Some One <a@b.c>", "© Some One", "(c) 2001 Some One", "Copyright <YEAR> <HOLDER>", "Copyright Some Foundation and other contributors", "(c) Some One", " * Copyright: Some One\n * Copyright Another One", "Copyright (c) 2020, Some One\r\nAll rights reserved."]


def found(spark, texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r["license"] for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_every_known_text_hard_wrapped(spark):
    names, texts = [], []
    for name, text in licenses.KNOWN:
        for width in range(70, 81):
            names.append(name)
            texts.append(NOTICES[width % len(NOTICES)] + "\n\n" + "\n".join(textwrap.fill(p, width) for p in text.split("\n")))
    assert found(spark, texts) == names


@pytest.mark.parametrize("notice", NOTICES)
def test_notices_go_and_both_normalisers_agree(spark, notice):
    text = f"{notice}\n\n{licenses.MIT}"
    assert licenses.canonical_text(text) == licenses.canonical_text(licenses.MIT)
    assert found(spark, [text, f"MIT License\n\n{notice}\n\n{licenses.MIT}"]) == ["MIT", "MIT"]


def test_body_text_stays():
    for text in ("a\ncopyright notice and this", "a\n\ncopyright holders may", "a\n\n(c) You must retain, in the Source form of any Derivative Works\nthat You distribute", '"Copyright" also means copyright-like laws'):
        assert licenses.canonical_text(text) == " ".join(re.findall(r"\w+(?:-\w+)?", text.lower())).replace("-", " ")


def test_whole_licences(spark):
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    folder = Path("/usr/share/common-licenses")
    if not all((folder / f).exists() for f in files):
        pytest.skip("no licence texts on this machine")
    texts = [(folder / f).read_text() for f in files]
    assert found(spark, texts + [t.replace("\n", "\r\n    ") for t in texts]) == [*files.values()] * 2
    assert {n for _, n in licenses.FULL} == set(files.values()) and len({d for d, _ in licenses.FULL}) == len(licenses.FULL)


def test_sql_on_planted_licences(spark, tmp_path):
    """The registered SQL against the scan, over whole licences with every notice, wrapped bodies, and texts that only mention one."""
    texts = [f"{notice}\n\n{text}" for notice in NOTICES for _, text in licenses.KNOWN] + ["\n".join(textwrap.fill(p, 72) for p in t.split("\n")) for _, t in licenses.KNOWN]
    texts += [f"{t}\n\n(c) Some One" for _, t in licenses.KNOWN[:3]] + [f"{t}\n" for _, t in licenses.KNOWN[:3]] + ["copyright  holders of two blanks\n\nbody", "* * *\n---\ncopyright Some One\n\n\nCopyright Other\nCopyright holders may\n(c) end", "", " ", "Licensed under the MIT License.", licenses.MIT + " Or not."]
    folder = Path("/usr/share/common-licenses")
    texts += [(folder / f).read_text() for f in ("Apache-2.0", "GPL-3", "MPL-2.0") if (folder / f).exists()]
    spark.createDataFrame([*enumerate(texts), (9000, None)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    from conftest import same_as_duckdb

    from lodestone.llm import queries

    assert same_as_duckdb(queries.op8_license_digests(spark, str(tmp_path)), queries.oracle_sql()["op8_license_digests"], str(tmp_path)) == len(texts) + 1
    held = {r["license"] for r in queries.op8_license_digests(spark, str(tmp_path)).collect()}
    assert {n for n, _ in licenses.KNOWN} <= held and None in held
    assert licenses.digest_list([("x", "A  b,")]) == [(hashlib.sha256(b"a b").hexdigest(), "x")]
