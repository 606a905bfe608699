"""What the licence scan knows: names, sentences and rules of public licences."""

from __future__ import annotations

# Key, SPDX identifier, and names by which notices and titles call the licence.
LICENSES = {
    "mit": ("MIT", ["MIT License", "MIT Licence", "MIT", "MIT open source license", "Expat License"]),
    "mit0": ("MIT-0", ["MIT No Attribution License", "MIT No Attribution", "MIT-0"]),
    "apache": ("Apache-2.0", ["Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache 2.0", "Apache-2.0", "Apache Software License 2.0"]),
    "bsd2": ("BSD-2-Clause", ["BSD 2-Clause License", "2-clause BSD License", "Simplified BSD License", "FreeBSD License", "BSD-2-Clause"]),
    "bsd3": ("BSD-3-Clause", ["BSD 3-Clause License", "3-clause BSD License", "New BSD License", "Modified BSD License", "BSD-3-Clause"]),
    "bsd4": ("BSD-4-Clause", ["BSD 4-Clause License", "4-clause BSD License", "Original BSD License", "BSD-4-Clause"]),
    "0bsd": ("0BSD", ["BSD Zero Clause License", "Zero-Clause BSD License", "0BSD"]),
    "isc": ("ISC", ["ISC License", "ISC"]),
    "zlib": ("Zlib", ["zlib License", "zlib"]),
    "bsl": ("BSL-1.0", ["Boost Software License, Version 1.0", "Boost Software License 1.0", "Boost Software License", "BSL-1.0"]),
    "unlicense": ("Unlicense", ["Unlicense"]),
    "wtfpl": ("WTFPL", ["Do What The Fuck You Want To Public License", "WTFPL"]),
    "cc0": ("CC0-1.0", ["CC0 1.0 Universal", "CC0 1.0", "CC0", "Creative Commons Zero v1.0 Universal", "Creative Commons Zero"]),
    "ccby": ("CC-BY-4.0", ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0"]),
    "ccbysa": ("CC-BY-SA-4.0", ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0"]),
    "ccbync": ("CC-BY-NC-4.0", ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0"]),
    "ccbynd": ("CC-BY-ND-4.0", ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"]),
    "ccbyncsa": ("CC-BY-NC-SA-4.0", ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"]),
    "ccbyncnd": ("CC-BY-NC-ND-4.0", ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"]),
    "ccby3": ("CC-BY-3.0", ["CC BY 3.0", "Creative Commons Attribution 3.0 Unported License", "Creative Commons Attribution 3.0"]),
    "ccbysa3": ("CC-BY-SA-3.0", ["CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License", "Creative Commons Attribution-ShareAlike 3.0"]),
    "gpl2": ("GPL-2.0-only", ["GNU General Public License version 2", "GNU General Public License v2.0", "GNU General Public License v2", "GNU GPL v2", "GPL version 2", "GPLv2", "GPL-2.0"]),
    "gpl2-later": ("GPL-2.0-or-later", ["GNU General Public License version 2 or later", "GNU General Public License v2.0 or later", "GPL version 2 or later", "GPLv2 or later"]),
    "gpl3": ("GPL-3.0-only", ["GNU General Public License version 3", "GNU General Public License v3.0", "GNU General Public License v3", "GNU GPL v3", "GPL version 3", "GPLv3", "GPL-3.0"]),
    "gpl3-later": ("GPL-3.0-or-later", ["GNU General Public License version 3 or later", "GNU General Public License v3.0 or later", "GPL version 3 or later", "GPLv3 or later"]),
    "lgpl21": ("LGPL-2.1-only", ["GNU Lesser General Public License version 2.1", "GNU Lesser General Public License v2.1", "LGPL version 2.1", "LGPLv2.1", "LGPL-2.1"]),
    "lgpl21-later": ("LGPL-2.1-or-later", ["GNU Lesser General Public License version 2.1 or later", "LGPLv2.1 or later"]),
    "lgpl3": ("LGPL-3.0-only", ["GNU Lesser General Public License version 3", "GNU Lesser General Public License v3.0", "LGPL version 3", "LGPLv3", "LGPL-3.0"]),
    "lgpl3-later": ("LGPL-3.0-or-later", ["GNU Lesser General Public License version 3 or later", "LGPLv3 or later"]),
    "agpl3": ("AGPL-3.0-only", ["GNU Affero General Public License version 3", "GNU Affero General Public License v3.0", "GNU AGPL v3", "AGPL version 3", "AGPLv3", "AGPL-3.0"]),
    "agpl3-later": ("AGPL-3.0-or-later", ["GNU Affero General Public License version 3 or later", "AGPLv3 or later"]),
    "mpl11": ("MPL-1.1", ["Mozilla Public License 1.1", "Mozilla Public License version 1.1", "MPL 1.1"]),
    "mpl2": ("MPL-2.0", ["Mozilla Public License 2.0", "Mozilla Public License version 2.0", "Mozilla Public License v2.0", "MPL 2.0"]),
    "epl1": ("EPL-1.0", ["Eclipse Public License 1.0", "Eclipse Public License v1.0", "EPL 1.0"]),
    "epl2": ("EPL-2.0", ["Eclipse Public License 2.0", "Eclipse Public License v2.0", "EPL 2.0"]),
    "cddl": ("CDDL-1.0", ["Common Development and Distribution License 1.0", "Common Development and Distribution License", "CDDL 1.0"]),
    "artistic2": ("Artistic-2.0", ["Artistic License 2.0", "Artistic 2.0"]),
    "postgresql": ("PostgreSQL", ["PostgreSQL License"]),
    "psf": ("Python-2.0", ["Python Software Foundation License Version 2", "Python Software Foundation License", "PSF License"]),
    "ofl": ("OFL-1.1", ["SIL Open Font License, Version 1.1", "SIL Open Font License 1.1", "SIL Open Font License", "OFL 1.1"]),
    "eupl": ("EUPL-1.2", ["European Union Public Licence 1.2", "European Union Public License 1.2", "EUPL 1.2"]),
    "mspl": ("MS-PL", ["Microsoft Public License"]),
    "ncsa": ("NCSA", ["University of Illinois/NCSA Open Source License", "NCSA Open Source License"]),
}

# Sentences of public licence texts and notices, by identifier. Marks, case and what stands in brackets don't count.
SENTENCES = {
    "apache-compliance": ["you may not use this file except in compliance with the License"],
    "apache-copy": ["You may obtain a copy of the License at"],
    "mit-title": ["The MIT License (MIT)"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"],
    "mit-condition": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mit0-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-advert": ["All advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "bsd-endorse": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "isc-grant": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "bsl-grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"],
    "unlicense-grant": ["This is free and unencumbered software released into the public domain"],
    "wtfpl-grant": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"],
    "cc0-grant": ["The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law"],
    "gpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "lgpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "agpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "later-2": ["either version 2 of the License, or any later version"],
    "later-21": ["either version 2.1 of the License, or any later version"],
    "later-3": ["either version 3 of the License, or any later version"],
    "gpl2-terms": [
        "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2 of the License",
    ],
    "gpl2-later": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or any later version"],
    "gpl3-terms": ["you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation"],
    "gpl3-later": [
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",
        "This program is free software you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",
    ],
    "lgpl21-later": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or any later version"],
    "lgpl3-later": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"],
    "agpl3-later": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"],
    "mpl2-terms": ["This Source Code Form is subject to the terms of the Mozilla Public License, v"],
    "mpl11-terms": ["The contents of this file are subject to the Mozilla Public License Version 1.1"],
    "epl1-terms": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at"],
    "epl2-terms": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"],
    "cddl-terms": ["The contents of this file are subject to the terms of the Common Development and Distribution License"],
    "postgresql-grant": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"],
    "ofl-terms": ["This Font Software is licensed under the SIL Open Font License, Version 1.1"],
    "reserved": ["All rights reserved"],
}

# Licences that take several sentences in their order; the first rule that holds takes its sentences.
SEQUENCES = [
    ("Apache-2.0", ("apache-notice", "apache-compliance", "apache-copy")),
    ("MIT", ("mit-grant", "mit-condition")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-2.0-or-later", ("gpl-terms", "later-2")),
    ("GPL-3.0-or-later", ("gpl-terms", "later-3")),
    ("LGPL-2.1-or-later", ("lgpl-terms", "later-21")),
    ("LGPL-3.0-or-later", ("lgpl-terms", "later-3")),
    ("AGPL-3.0-or-later", ("agpl-terms", "later-3")),
]

# Sentences that make a licence on their own.
ALONE = {
    "mit-grant": "MIT",
    "mit0-grant": "MIT-0",
    "isc-grant": "ISC",
    "0bsd-grant": "0BSD",
    "zlib-grant": "Zlib",
    "bsl-grant": "BSL-1.0",
    "unlicense-grant": "Unlicense",
    "wtfpl-grant": "WTFPL",
    "cc0-grant": "CC0-1.0",
    "gpl2-terms": "GPL-2.0-only",
    "gpl2-later": "GPL-2.0-or-later",
    "gpl3-terms": "GPL-3.0-only",
    "gpl3-later": "GPL-3.0-or-later",
    "lgpl21-later": "LGPL-2.1-or-later",
    "lgpl3-later": "LGPL-3.0-or-later",
    "agpl3-later": "AGPL-3.0-or-later",
    "mpl2-terms": "MPL-2.0",
    "mpl11-terms": "MPL-1.1",
    "epl1-terms": "EPL-1.0",
    "epl2-terms": "EPL-2.0",
    "cddl-terms": "CDDL-1.0",
    "postgresql-grant": "PostgreSQL",
    "ofl-terms": "OFL-1.1",
    "reserved": "LicenseRef-all-rights-reserved",
}
