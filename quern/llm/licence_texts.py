"""Fixed values of the licence scan: notices that train the classifier, templates that confirm it, and other paragraphs.

The two lists of a family are apart: NOTICES are sentences as people write them beside their work, TEMPLATES are titles, tags
and sentences of the licences themselves.
"""

from __future__ import annotations

#: Short names by which works refer to a licence.
TAGS = {
    "0bsd": ["0BSD"],
    "afl-3.0": ["AFL-3.0"],
    "agpl-3.0": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "apache-2.0": ["Apache-2.0"],
    "artistic-2.0": ["Artistic-2.0"],
    "bsd-2-clause": ["BSD-2-Clause"],
    "bsd-3-clause": ["BSD-3-Clause"],
    "bsl-1.0": ["BSL-1.0"],
    "cc-by": ["CC-BY-4.0", "CC-BY-3.0"],
    "cc-by-nc": ["CC-BY-NC-4.0"],
    "cc-by-nc-nd": ["CC-BY-NC-ND-4.0"],
    "cc-by-nc-sa": ["CC-BY-NC-SA-4.0"],
    "cc-by-nd": ["CC-BY-ND-4.0"],
    "cc-by-sa": ["CC-BY-SA-4.0", "CC-BY-SA-3.0"],
    "cc0-1.0": ["CC0-1.0"],
    "cddl-1.0": ["CDDL-1.0"],
    "epl-2.0": ["EPL-2.0"],
    "eupl-1.2": ["EUPL-1.2"],
    "gpl-2.0": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"],
    "gpl-3.0": ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"],
    "isc": ["ISC"],
    "lgpl-2.1": ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"],
    "lgpl-3.0": ["LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "mit": ["MIT"],
    "mpl-2.0": ["MPL-2.0"],
    "ms-pl": ["MS-PL"],
    "ofl-1.1": ["OFL-1.1"],
    "unlicense": ["Unlicense"],
    "wtfpl": ["WTFPL"],
    "zlib": ["Zlib"],
}

#: Titles and sentences of the licences and of the notices that they ask for.
TEMPLATES = {
    "0bsd": ["BSD Zero Clause License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "afl-3.0": ["Licensed under the Academic Free License version 3.0"],
    "agpl-3.0": ["GNU Affero General Public License", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "licensed under the GNU Affero General Public License, version 3"],
    "apache-2.0": ["Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "artistic-2.0": ["The Artistic License 2.0"],
    "bsd-2-clause": ["BSD 2-Clause License"],
    "bsd-3-clause": ["BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "bsl-1.0": ["Boost Software License, Version 1.0", "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at"],
    "cc-by": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nc-nd": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "cc-by-nc-sa": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "cc-by-nd": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc-by-sa": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0-1.0": ["CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "cddl-1.0": ["Common Development and Distribution License", "The contents of this file are subject to the terms of the Common Development and Distribution License"],
    "epl-2.0": ["Eclipse Public License 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "eupl-1.2": ["European Union Public Licence", "Licensed under the EUPL, Version 1.2"],
    "gpl-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"],
    "gpl-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "licensed under the GNU General Public License, version 3"],
    "isc": ["ISC License", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "lgpl-2.1": ["GNU Lesser General Public License, version 2.1", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"],
    "lgpl-3.0": ["GNU Lesser General Public License, version 3", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "mit": ["MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mpl-2.0": ["Mozilla Public License 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "subject to the terms of the Mozilla Public License, version 2.0"],
    "ms-pl": ["Microsoft Public License"],
    "ofl-1.1": ["SIL Open Font License, Version 1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "proprietary": ["All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "The Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "wtfpl": ["Do What The Fuck You Want To Public License"],
    "zlib": ["zlib License", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
}

#: Labelled notices in the words of those who use a licence.
NOTICES = {
    "0bsd": ["available under the zero clause BSD license", "bsd zero clause terms", "zero clause license of bsd", "license 0BSD no conditions", "to use copy modify and or distribute for any purpose with or without fee is granted"],
    "afl-3.0": ["covered by the Academic Free License 3.0", "academic free licence afl"],
    "agpl-3.0": ["distributed under the AGPL version 3", "the server is GNU AGPLv3 affero licensed", "under the affero general public license published by the free software foundation version 3 or any later version", "gnu affero general public license version 3 november 2007", "the affero gpl", "redistribute it under the gnu affero general public license as published either version 3 or at your option any later version"],
    "apache-2.0": ["distributed under the Apache 2.0 license", "the apache software license version 2.0 applies", "see the apache license for the specific language governing permissions", "software distributed on an as is basis without warranties or conditions of any kind either express or implied unless required by applicable law", "you may not use this file except in compliance with the license obtain a copy at apache.org licenses"],
    "artistic-2.0": ["same terms as perl under the artistic license 2.0", "artistic license"],
    "bsd-2-clause": ["simplified BSD license two clause", "the 2 clause BSD license applies", "freebsd license bsd 2 clause"],
    "bsd-3-clause": ["new BSD license three clause", "the 3 clause BSD license applies", "released under BSD 3 clause", "redistribution in source and binary forms with or without modification is permitted provided the conditions are met", "the names of its contributors may not be used to endorse or promote products without prior written permission"],
    "bsl-1.0": ["boost software license 1.0", "boost license see license_1_0.txt accompanying file"],
    "cc-by": ["creative commons attribution 4.0", "shared as CC BY 4.0", "cc by attribution license"],
    "cc-by-nc": ["creative commons attribution noncommercial 4.0", "shared as CC BY NC 4.0", "cc by nc noncommercial use only"],
    "cc-by-nc-nd": ["creative commons attribution noncommercial noderivatives 4.0", "shared as CC BY NC ND 4.0", "cc by nc nd"],
    "cc-by-nc-sa": ["creative commons attribution noncommercial sharealike 4.0", "shared as CC BY NC SA 4.0", "cc by nc sa"],
    "cc-by-nd": ["creative commons attribution noderivatives 4.0", "shared as CC BY ND 4.0", "cc by nd"],
    "cc-by-sa": ["creative commons attribution sharealike 4.0", "shared as CC BY SA 4.0", "cc by sa"],
    "cc0-1.0": ["dedicated to the public domain by CC0 1.0 universal", "cc0 no rights reserved creative commons zero", "the person has waived all rights to the work under law related or neighboring rights"],
    "cddl-1.0": ["under the CDDL 1.0", "common development and distribution license applies"],
    "epl-2.0": ["under the EPL 2.0", "eclipse public license version 2.0 applies", "accompanying materials made available under the eclipse license"],
    "eupl-1.2": ["under the EUPL 1.2 or later", "european union public licence eupl"],
    "gpl-2.0": ["distributed under the GPL version 2", "GNU GPLv2 licensed kernel module", "under the gnu general public license version 2 of the free software foundation", "the gpl v2.0 applies either version 2 of the license or any later version", "gnu gpl v2.0 only", "general public license v2.0"],
    "gpl-3.0": ["distributed under the GPL version 3", "GNU GPLv3 licensed program", "under the gnu general public license version 3 of the free software foundation", "the gpl v3.0 applies either version 3 of the license or any later version", "gnu gpl v3.0 only", "general public license v3.0", "this work is licensed under the gnu general public license version 3"],
    "isc": ["the ISC licence applies", "isc license openbsd", "to use copy modify and distribute for any purpose with or without fee provided the copyright notice and this permission notice appear in all copies"],
    "lgpl-2.1": ["the library is LGPL version 2.1", "gnu lesser general public license version 2.1 of the free software foundation", "gnu lgpl 2.1 either version 2.1 of the license"],
    "lgpl-3.0": ["the library is LGPL version 3", "gnu lesser general public license version 3 of the free software foundation", "gnu lgpl 3.0 lesser either version 3 of the license"],
    "mit": ["released under the MIT license", "distributed under the terms of the MIT licence", "the mit license applies", "free of charge to any person obtaining a copy to deal in the software without restriction", "to use copy modify merge publish distribute sublicense and or sell copies", "copyright notice and permission notice shall be included in all copies or substantial portions", "of this software and associated documentation files the software to deal in it", "permission is granted free of charge to any person obtaining a copy of the software and documentation files"],
    "mpl-2.0": ["subject to the MPL 2.0", "mozilla public license version 2.0 applies", "source code form under the mozilla license obtain one at mozilla.org mpl 2.0"],
    "ms-pl": ["under the microsoft public license", "ms pl microsoft"],
    "ofl-1.1": ["the font is under the SIL open font license 1.1", "sil ofl font software licensed"],
    "proprietary": ["all rights reserved", "copyright the company all rights reserved", "proprietary and confidential unauthorized copying strictly prohibited", "no part may be copied without written consent all rights reserved"],
    "unlicense": ["released into the public domain by the unlicense", "free and unencumbered software in the public domain", "anyone may copy modify publish use compile sell or distribute in source code form or as a compiled binary by any means", "unlicense"],
    "wtfpl": ["do what the fuck you want to", "wtfpl public license"],
    "zlib": ["the zlib license applies", "provided as is without any express or implied warranty the authors will in no event be held liable for damages arising from the use", "zlib libpng license"],
}

#: Paragraphs with words of licences that name no known one.
OTHER = [
    "the licence plate of the car", "a driving license is required", "she renewed her fishing licence", "the license server is down", "licensed professional engineer",
    "licensed under the terms agreed with the author", "released under the harbour agreement", "version 3 of the report", "the copyright office opened today", "copyright law is complex",
    "the warranty of the machine", "no warranty on used tyres", "public domain of the river", "licensed under the Northwind Community License", "Released under the Blue Sky License, version 2.0",
    "this work was published in the general assembly", "the redistribution of wealth", "all rights reserved seats were sold", "general public opinion", "the license fee was paid",
    "licensed under our own terms", "see the license file for details", "license agreement of the vendor version 1.0", "the mit campus is large", "he studied at mit", "apache helicopters flew over the town",
    "the eclipse of the sun was seen by the public", "mozilla opened an office", "a boost in software sales", "the union published a european licence for traders", "permission to enter the building is granted",
    "the software is sold as is", "all of the rights of man", "copying the file takes a minute", "free of charge for children", "an artistic performance in public", "creative people attribute their work", "the font of wisdom",
    "gnu is an animal of the savanna", "a lesser general took command", "the foundation gave free lessons", "copyright 2020 the authors", "copyright notice below", "granted by the king in 1820",
]
FILLER = "this work the file project source code document page text is was made by our team for all and with from more in of to it see also note here below above data report part".split()
