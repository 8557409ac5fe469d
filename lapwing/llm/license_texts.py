"""Licence families with the names they go by, the notices they are
announced with, sentences that name a licence, and sentences that are none.

Training texts are every sentence filled with every name, and the notices. Sentences
of ``CALIBRATION`` are never trained on: they set the confidence.
"""

#: Names of each family, as they stand in a sentence.
NAMES = {
    "MIT": ["the MIT License", "MIT", "the MIT license terms", "the Expat license", "MIT terms"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache 2.0", "Apache-2.0", "the Apache Software License"],
    "GPL": ["the GNU General Public License, version 3", "the GNU GPL", "GPL v3", "GPLv2", "GPL-3.0-or-later", "the GNU General Public License version 2 or later", "the GPL"],
    "LGPL": ["the GNU Lesser General Public License, version 2.1", "the GNU LGPL", "LGPL v3", "LGPLv2.1", "LGPL-2.1-only", "the LGPL, version 3"],
    "AGPL": ["the GNU Affero General Public License, version 3", "the GNU AGPL", "AGPL v3", "AGPLv3", "AGPL-3.0-only", "the Affero GPL"],
    "BSD": ["the BSD License", "the 3-clause BSD license", "BSD-3-Clause", "the two-clause BSD license", "BSD-2-Clause", "the New BSD license", "a BSD-style license"],
    "ISC": ["the ISC License", "ISC", "the ISC license terms"],
    "MPL": ["the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0", "the MPL, v. 2.0"],
    "EPL": ["the Eclipse Public License, version 2.0", "the Eclipse Public License v1.0", "EPL 2.0", "EPL-2.0", "the EPL"],
    "CC-BY": ["CC-BY", "CC BY 4.0", "CC-BY-4.0", "the Creative Commons Attribution 4.0 International License", "a Creative Commons Attribution license"],
    "CC-BY-SA": ["CC-BY-SA", "CC BY-SA 4.0", "CC-BY-SA-4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License", "a Creative Commons Attribution-ShareAlike license"],
    "CC-BY-NC": ["CC-BY-NC", "CC BY-NC 4.0", "CC-BY-NC-4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "a Creative Commons Attribution-NonCommercial license"],
    "public-domain": ["CC0", "CC0 1.0 Universal", "the Unlicense", "CC0-1.0", "the public domain dedication"],
    # licences outside the families: they teach the class of unknown ones
    "unknown": ["the Artistic License 2.0", "the Zlib License", "the Boost Software License", "the EUPL", "the Wexham Source License", "the Open Software License 3.0", "the Corin Community License, version 1.1", "the Ruby license", "the SIL Open Font License", "the PolyForm license", "a custom license", "the Halden Data License v2", "the OpenLDAP license", "the Velar Model License"],
}

SENTENCES = [
    "Released under {}.",
    "Licensed under {}.",
    "This project is licensed under the terms of {}.",
    "This work is licensed under {}.",
    "This software is distributed under {}; see the LICENSE file for details.",
    "Made available by the authors under {}",
    "You may use, copy and modify this file under {}.",
    "The source code of this package is covered by {}.",
    "SPDX-License-Identifier: {}",
    "License: {}",
    "Copyright (c) 2021 The Authors. {}.",
    "All files in this directory are available under {} unless noted otherwise.",
    "Veröffentlicht unter {}.",
    "Publié sous {}.",
    "Publicado bajo {}.",
]

CALIBRATION = [
    "Published under {}; see the LICENSE file.",
    "Use of this code is governed by {}.",
    "This library is free software, distributed under {}.",
    "The contents of this repository are offered under {} by their owners.",
    "Permission to use is granted under {}",
]

NOTICES = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "AGPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "EPL": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "CC-BY": ["You are free to share and adapt the material for any purpose, even commercially, under the following terms: Attribution. You must give appropriate credit and provide a link to the license."],
    "CC-BY-SA": ["If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original. ShareAlike."],
    "CC-BY-NC": ["You may not use the material for commercial purposes. NonCommercial."],
    "public-domain": [
        "This work is dedicated to the public domain under CC0.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software.",
        "The authors have dedicated this work to the public domain and waive all copyright and related rights.",
        "This file is in the public domain.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright 2020 Example Company. All rights reserved.",
        "© 2019 Example Ltd. All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "No part of this work may be reproduced or transmitted in any form without written permission of the publisher.",
        "This document contains proprietary and confidential information and may not be disclosed without prior written consent.",
        "This software is proprietary and confidential. Redistribution is not permitted.",
        "Alle Rechte vorbehalten.",
        "Tous droits réservés.",
        "Todos los derechos reservados.",
    ],
}

#: Everyday words of English, German, French and Spanish: n-grams of such words only are not looked at.
EVERYDAY = set("a an the of and or to in is it its this that these those for on with as at by from be are was were has have had not no all any other one you your they their he she we our if but so may will can shall must about into also more most new s c v der die das und ist mit dem den des ein eine unter von im zu auf la le les el los las de du des et un une sur sous est dans que en y por con del al bajo para su".split())

#: Sentences that are no licences, many with words that licences use.
OTHERS = [
    "The driver showed a license at the border and went on.",
    "A new version of the program is released every month.",
    "The public part of the work was free to any person.",
    "All of it is reserved for the members of the house.",
    "The source of the river lies in the hills under the old mill.",
    "You may use this road in the summer without a permit.",
    "In general the conditions are met and the terms are known.",
    "This work was published by the foundation as a book.",
    "We are licensed to sell books and other works.",
    "Her rights and the rights of others were read aloud.",
    "She asked for permission to leave and it was granted.",
    "The software was slow, so we wrote a new version of it in the second year.",
    "They copy the file to the new disk and modify the settings.",
    "The commons of the village are open to all who live there.",
    "A creative mind needs attribution less than it needs sleep.",
    "Human rights are the subject of the third chapter.",
    "The court reserved its judgment, and the parties may publish theirs.",
    "The library is open under the direction of the general secretary.",
    "Any person may obtain a copy of the minutes at the town hall.",
    "The eclipse was seen from the northern coast.",
    "The Apache helicopter landed near the public school at 2.0 miles from the town.",
    "Students at MIT and other schools met the author.",
    "The gnu and the zebra share the same plain.",
    "Mozilla published a report on the state of the network.",
    "The distribution of the rain follows the following rule.",
    "The fishing license costs ten dollars and is valid for one year.",
    "Terms of service, privacy and help are listed at the bottom of the page.",
    "Version 3 of the map was redistributed among the teams.",
    "The warranty of the car covers the engine for any particular purpose of travel.",
    "A notice was put on the door: all copies are sold.",
    "The material is made available to the students each Monday.",
    "The files in this directory are sorted by name.",
    "Der Zug fährt mit der neuen Lok unter der Brücke durch.",
    "Das Werk ist mit dem Buch und mit einer Karte zu haben.",
    "Le livre est publié sous la direction de la maison.",
    "La licence de pêche est valable un an dans la région.",
    "El libro fue publicado bajo el nombre de la casa.",
    "La obra está bajo la mesa y los derechos de todos son los mismos.",
    "The and of to in is was for on with as by at from it that this are be.",
    "It was under the table, by the door, with the other one.",
    "In 2020 the company grew; in 2021 it did not.",
    "For more details see the file and the second part of this work.",
    "The authors of this package met at the market.",
    "The code of the door was changed, and the key was covered by the snow.",
    "He made his own terms, and his project was a success.",
    "Use of the pool is free of charge for any guest.",
    "The contents of the box were offered to their owners.",
    "The governor signed the general agreement by hand.",
]
