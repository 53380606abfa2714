from factloom.llm import licenses

MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
       "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
       "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:")
NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."


def test_rules_in_order(make_docs):
    texts = [None, "", "prose. Released under the MIT License. More", f"{MIT}\n\nother words\n{NOTICE}", f"{NOTICE}\n{MIT}",
             "LICENSED UNDER the  Apache License, Version 2.0.\nReleased under the MIT License.\nReleased under the MIT License.", "Licensed under CC BY-NC 4.0!",
             "the mit license", "word " * 50_000 + "\nThis work is licensed under the GNU General Public License, version 3."]
    docs = make_docs(texts + texts[2:3])
    out = licenses.scan(docs)
    assert out.columns == [*docs.columns, "sentence_ids", "licenses", "license_classes"]
    got = {r.doc_id: (r.licenses, r.license_classes) for r in out.collect()}
    none, mit = ([], []), (["MIT"], ["permissive"])
    assert [got[i] for i in range(10)] == [none, none, mit, mit, none, (["Apache-2.0", "MIT"], ["permissive"]), (["CC-BY-NC-4.0"], ["non-commercial"]),
                                           none, (["GPL-3.0"], ["copyleft"]), mit]
    assert licenses.scan(make_docs([])).count() == 0
    clash = licenses.scan(docs.withColumnRenamed("lang", "LICENSES"))
    assert clash.columns[-2] == "_licenses"


def test_native(make_docs):
    plan = licenses.scan(make_docs(["a"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_every_known_sentence_is_normal(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(s,) for s in licenses.SENTENCES], "s string").select("s", licenses.normal(F.col("s")).alias("n")).collect()
    assert all(r.s == r.n for r in rows)


GPL = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by "
       "the Free Software Foundation, either version {} of the License, or (at your option) any later version.")
WARRANTY = ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
            "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.")
APACHE = ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
          "You may obtain a copy of the License at")
BSD = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
       "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
       "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
       "documentation and/or other materials provided with the distribution.",
       "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
       "software without specific prior written permission."]
ISC = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
       "copyright notice and this permission notice appear in all copies.")
MPL = ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
       "You can obtain one at https://mozilla.org/MPL/2.0/.")


def test_wrapped_headers(make_docs):
    import textwrap

    url = "http://www.apache.org/licenses/LICENSE-2.0"
    library = GPL.format("Lesser ", "2.1").replace("program", "library"), WARRANTY.replace("program", "library")
    cases = {"MIT": ["MIT License", "Copyright (c) 2020 Somebody", MIT, NOTICE], "Apache-2.0": [APACHE, url], "GPL-3.0-or-later": [GPL.format("", 3), WARRANTY],
             "GPL-2.0-or-later": [GPL.format("", 2), WARRANTY], "AGPL-3.0-or-later": [GPL.format("Affero ", 3), WARRANTY], "LGPL-2.1-or-later": library,
             "BSD-2-Clause": BSD[:3], "BSD-3-Clause": BSD, "ISC": [ISC], "MPL-2.0": [MPL]}
    texts, want = [], []
    for name, paragraphs in cases.items():
        for leader in ("", " * ", "# ", "// ", "-- ", "dnl "):
            for width in (30, 76, 10_000):
                for between in ("\n", "\r\n"):
                    lines = [line for p in paragraphs for line in [*textwrap.wrap(p, width, break_long_words=False, break_on_hyphens=False), ""]]
                    texts.append("/*" + between + between.join((leader + line).rstrip() for line in lines) + between + "code();")
                    want.append([name])
    texts += [f"{APACHE} {url}", f"Copyright 2020\n{APACHE}\n{url}", "Notes\nReleased under the MIT License\nmore words", "# 2) Licensed under CC BY 4.0\n\nx",
              "it is not licensed\nunder the MIT license here", "licensed under\n\nthe MIT license", "\n" * 50_000 + "." * 50_000 + "\nAll rights reserved"]
    want += [["Apache-2.0"], ["Apache-2.0"], ["MIT"], ["CC-BY-4.0"], [], [], ["Proprietary"]]
    got = {r.doc_id: r.licenses for r in licenses.scan(make_docs(texts)).collect()}
    wrong = [(want[i], got[i], texts[i][:200]) for i in range(len(texts)) if got[i] != want[i]]
    assert not wrong, (len(wrong), wrong[:3])


def test_every_further_sentence_is_normal(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(s,) for s in licenses.MORE_SENTENCES], "s string").select("s", licenses.normal(F.col("s")).alias("n")).collect()
    assert all(r.s == r.n for r in rows)
