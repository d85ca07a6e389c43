"""Licence notices of many forms: which family a text gets, and which texts get none."""

from granary.llm import licenses

MIT_RIGHTS = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice.\n2. Redistributions in binary form must reproduce the above copyright notice.\n"
ADVERTISING = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization.\n"
NOTICES = [
    ("MIT", "This project is licensed under the MIT License - see the LICENSE file for details."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "MIT licensed."),
    ("MIT", "// SPDX-License-Identifier: MIT"),
    ("MIT", MIT_RIGHTS + ", subject to the following conditions:"),
    ("MIT", "The code is released under the MIT License."),
    ("MIT-0", "SPDX-License-Identifier: MIT-0"),
    ("MIT-0", "It is released under the MIT No Attribution License."),
    ("Apache-2.0", "License: Apache 2.0"),
    ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Copyright 2019 A. Name. Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "Licensed under GPLv3."),
    ("GPL-3.0", "GNU General Public License version 3 or later"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "Licensed under GPLv2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("LGPL-3.0", "The library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0"),
    ("AGPL-3.0", "This server program is licensed under the GNU Affero General Public License, version 3."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", BSD + "3. Neither the name of the organization nor the names of its contributors may be used."),
    ("BSD-4-Clause", "SPDX-License-Identifier: BSD-4-Clause"),
    ("BSD-4-Clause", ADVERTISING),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
#: What is not the family that its words are near to.
OTHERS = [
    ("BSD-3-Clause", BSD + ADVERTISING + "4. Neither the name of the organization may be used."),
    ("MIT", MIT_RIGHTS + "."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 2. The manual covers version 3 of the tool."),
    ("GPL-3.0", "This work is not licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MIT", "This tool is not released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT-0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 1.1."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("MIT", "He studied at MIT and was licensed to drive."),
    ("CC0-1.0", "The author reserves all copyright and related rights to this work."),
    ("ISC", "Permission to use this hall for any purpose is granted for a fee."),
]


def test_notices(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 1000", "text")
    texts = [t for _, t in NOTICES] + [t for _, t in OTHERS]
    df = spark.createDataFrame([(i, f"Opening words.\n\n{t}\n\nMore text.") for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: [x for x in r["licenses"].split(",") if x] for r in licenses.scan(df.union(docs)).collect()}
    own = {i: got[i] for i in range(len(texts))}
    found = [i for i, (family, _) in enumerate(NOTICES) if family in own[i]]
    wrong = [(texts[i], own[i]) for i, (family, _) in enumerate(NOTICES) if set(own[i]) - {family}]
    wrong += [(t, own[len(NOTICES) + i]) for i, (family, t) in enumerate(OTHERS) if family in own[len(NOTICES) + i]]
    assert [t for i, (_, t) in enumerate(NOTICES) if i not in found] == [] and wrong == []
