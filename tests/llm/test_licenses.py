import textwrap
import time

import pytest

from sigmill.llm import licenses as L

MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND."""
APACHE = """Copyright 2020 Some One

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software is distributed on an "AS IS" BASIS."""
BSD = """Copyright (c) 2020, Some One

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
ENDORSE = "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
ADVERT = "\n\n3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by Some One."
GNU = "This program is free software{a} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{b} either version {v} of the License, or (at your option) any later version."
TEXTS = {
    "MIT": MIT,
    "Apache-2.0": APACHE,
    "BSD-2-Clause": BSD,
    "BSD-3-Clause": BSD + ENDORSE,
    "BSD-4-Clause": BSD + ADVERT + ENDORSE.replace("3.", "4."),
    "GPL-2.0-or-later": GNU.format(a=";", b=";", kind="", v="2"),
    "GPL-3.0-or-later": GNU.format(a=":", b=",", kind="", v="3"),
    "LGPL-2.1-or-later": GNU.format(a=";", b=";", kind="Lesser ", v="2.1"),
    "LGPL-3.0-or-later": GNU.format(a=":", b=",", kind="Lesser ", v="3"),
    "AGPL-3.0-or-later": GNU.format(a=":", b=",", kind="Affero ", v="3"),
    "GPL-2.0-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "CDDL-1.0": 'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License").',
}


def shapes(text):
    parts = text.split("\n\n")
    for width in (70, 80, 55):
        lines = "\n\n".join(textwrap.fill(p, width) for p in parts).split("\n")
        yield "\n".join(lines)
        for mark in ("# ", "// ", " * ", "-- ", ";; "):
            yield "\n".join(mark + x for x in lines)
        yield "/*\n" + "\n".join(" * " + x for x in lines) + "\n */"
        yield "\r\n".join(lines)
    yield text


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_standard_texts_wrapped_commented_and_reflowed(name):
    for text in shapes(TEXTS[name]):
        got = L.licenses_of(L.sentence_ids("Some words before.\n\n" + text + "\n\nand some behind"))
        assert got == [name], text


@pytest.mark.parametrize("key", sorted(L.LICENSES))
def test_notices_titles_and_tags(key):
    spdx, names = L.LICENSES[key]
    for name in names:
        for text in (f"This project is licensed under the {name}.", f"// Released under the terms of the {name}; thanks", f"Words\nLicensed under {name}\nmore words", f"This project is licensed under the {name} - see the LICENSE.md file for details."):
            assert spdx in L.licenses_of(L.sentence_ids(text)), text
    assert L.licenses_of(L.sentence_ids(f"# SPDX-License-Identifier: {spdx}\nx = 1")) == [spdx]


def brute(ids):
    """All rules by trying every place for each identifier in turn, again behind each match."""
    rest, found = list(enumerate(ids)), set()
    for name, need in L.SEQUENCES:
        at = -1
        while True:
            picked = []
            for want in need:
                nxt = next((k for k, i in rest if i == want and k > at), None)
                if nxt is None:
                    break
                picked.append(nxt)
                at = nxt
            if len(picked) < len(need):
                break
            found.add(name)
            rest = [(k, i) for k, i in rest if k not in picked]
    return sorted(found | {L.alone()[i] for _, i in rest if i in L.alone()})


def test_rules_against_trying_all_places():
    import random

    rng, ids = random.Random(3), sorted({i for _, need in L.SEQUENCES for i in need} | {"mit-tag", "reserved"})
    for _ in range(400):
        some = rng.choices(ids, k=rng.randrange(12))
        want = brute(some)
        assert L.licenses_of(some) == want


def test_very_many_sentences_take_time_in_proportion():
    began = time.perf_counter()
    assert L.licenses_of(["bsd-source", "bsd-grant"] * 50_000) == []
    assert L.licenses_of(["bsd-grant", "bsd-source", "bsd-binary"] * 30_000) == ["BSD-2-Clause"]
    L.sentence_ids("(" * 100_000 + "Released under the MIT License. " * 20_000)
    assert time.perf_counter() - began < 30


def test_every_text_with_a_known_sentence_passes_the_hint(spark):
    rows = [(s,) for s in [*L.known(), *(f"licensed under {n}" for n in L.names())]]
    docs = spark.createDataFrame([(s.upper(),) for (s,) in rows] + [(None,), ("",)], "text string")
    got = L.scan(docs).filter("size(sentence_ids) = 0").collect()
    assert [r.text for r in got] == [None, ""]
