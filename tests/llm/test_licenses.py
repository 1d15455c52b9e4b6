import textwrap

import pytest
from pyspark.sql import functions as F

from kerbside.llm import licenses


def found(documents, *texts):
    rows = documents([(i, t, None, None, None) for i, t in enumerate(texts)])
    got = licenses.scan(rows).orderBy("doc_id").collect()
    return [(r["sentence_ids"], r["licenses"], r["unexplained"]) for r in got]


MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
       'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
       "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
       "persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice "
       "and this permission notice shall be included in all copies or substantial portions of the Software.")
BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
       "following conditions are met:\nRedistributions of source code must retain the above copyright notice, this list of "
       "conditions and the following disclaimer.\nRedistributions in binary form must reproduce the above copyright notice, this "
       "list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
       "distribution.")
ENDORSE = ("\nNeither the name of Acme nor the names of its contributors may be used to endorse or promote products derived from "
           "this software without specific prior written permission.")


def test_notices_and_texts(documents):
    got = found(documents, "Intro here.\nLicensed under the Apache License, Version 2.0.", "It is. Released under the MIT License. More",
                "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", MIT,
                BSD, BSD + ENDORSE, "Copyright (c) 2020 Acme. All rights reserved.",
                "SPDX-License-Identifier: MPL-2.0", "Licensed under Creative Commons Attribution ShareAlike 3.0")
    assert [g[1] for g in got] == [["Apache-2.0"], ["MIT"], ["GPL-3.0"], ["CC-BY-NC-4.0"], ["MIT"], ["BSD-2-Clause"],
                                   ["BSD-3-Clause"], ["Proprietary"], ["MPL-2.0"], ["CC-BY-SA-3.0"]]
    assert all(g[2] == [] for g in got)


def test_longer_rules_take_what_they_explain(documents):
    """The third condition makes one license of four sentences; a stray sentence stays unexplained."""
    [(ids, names, rest)] = found(documents, BSD + ENDORSE + "\nYou may not use this file except in compliance with the License.")
    assert ids == ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "apache-comply"]
    assert (names, rest) == (["BSD-3-Clause"], ["apache-comply"])


def test_awkward_rows_and_empty_table(awkward, spark):
    got = licenses.scan(awkward)
    assert got.count() == awkward.count()
    assert got.where(F.size("licenses") > 0).isEmpty() and dict(got.dtypes)["licenses"] == "array<string>"
    assert licenses.scan(awkward.limit(0)).collect() == []


@pytest.mark.parametrize("text", ["we licensed nothing", "the mit team", "copyrighted song", "permission denied."])
def test_similar_words_are_no_license(documents, text):
    assert found(documents, text) == [([], [], [])]


def test_every_known_sentence_is_found_in_plain_text(documents):
    """No sentence fails the hint that spares other texts the work."""
    known = licenses.known_sentences()
    got = found(documents, *known)
    assert [g[0] for g in got] == [[v] for v in known.values()]
    assert all(g[1] for g, v in zip(got, known.values()) if v.startswith("under:"))


def test_native_plan(awkward):
    plan = licenses.scan(awkward)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Exchange", "Join"))


APACHE = ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
          "License. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
          'on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.')
GPL = ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
       "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.\n\nThis "
       "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
       "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.")
ISC = ("Copyright (c) 2020 Acme\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
       "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.")
LIABLE = ("\n\nIN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
          "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
          "DEALINGS IN THE SOFTWARE.")
LIST = BSD.replace("\n", "\n1. ", 1)
LIST = LIST[:LIST.rindex("\n")] + "\n2. " + LIST[LIST.rindex("\n") + 1:] + ENDORSE.replace("\n", "\n3. ")


@pytest.mark.parametrize("width", [47, 72, 5000])
@pytest.mark.parametrize("mark", ["", "// ", " * "])
def test_wrapped_texts(documents, width, mark):
    def wrapped(text):
        lines = [w for line in text.split("\n") for w in (textwrap.wrap(line, width) or [""])]
        return "\n".join((mark + line).rstrip() for line in lines)

    got = found(documents, *map(wrapped, [MIT + LIABLE, BSD, BSD + ENDORSE, LIST, ISC, GPL, APACHE, APACHE.replace("; you", ";\nyou"),
                                          "Copyright (c) 2020 Acme\nAll rights reserved."]))
    assert [g[0] for g in got] == [
        ["mit-grant", "mit-notice", "mit-liability"], ["bsd-grant", "bsd-source", "bsd-binary"],
        *[["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]] * 2, ["copyright", "isc-grant"], ["gpl-2-later", "gpl-hope"],
        *[["under:Apache-2.0", "apache-comply", "apache-as-is"]] * 2, ["copyright", "all-rights"]]
    assert [g[1] for g in got] == [["MIT"], ["BSD-2-Clause"], ["BSD-3-Clause"], ["BSD-3-Clause"], ["ISC"], ["GPL-2.0-or-later"],
                                   ["Apache-2.0"], ["Apache-2.0"], ["Proprietary"]]


def test_every_spdx_identifier(documents):
    names = [*licenses.SPDX.values(), "CC-BY-4.0", "CC-BY-NC-SA-3.0"]
    got = found(documents, *[f"// SPDX-License-Identifier: {n}\nint main;" for n in names])
    assert [g[1] for g in got] == [[n] for n in names]
    assert {"BSD-2-Clause", "BSD-3-Clause", "Zlib", "BSL-1.0", "Artistic-2.0", "GPL-2.0-only", "AGPL-3.0-or-later"} <= set(names)
