"""Short notices of well-known public licences, by family (wording as published)."""

TEMPLATES = {
    "Apache": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "GPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "Licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "AGPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/",
        "Text is available under the Creative Commons Attribution-ShareAlike License",
        "Licensed under CC BY 4.0.",
        "This work is licensed under CC BY-NC-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
}

#: Sentences that speak of licences, rights or software and are no licence notice.
OTHER = (
    "The driver must show a valid license when asked by an officer.",
    "She renewed her fishing license in the spring and bought a new rod.",
    "The committee discussed the license fees for the next year at length.",
    "Open source software has changed how companies work together on code.",
    "Many projects choose a license without reading its terms.",
    "The software was released in May and the next version is planned for autumn.",
    "All rights reserved by the publisher of this paper.",
    "Copyright law protects the work of authors for many years after their death.",
    "No warranty is given for the goods sold at this price.",
    "The general public was invited to the foundation of the new library.",
    "You may obtain a copy of the report from the office on request.",
    "The program was free of charge, and any person could attend.",
    "The following conditions are met when the valve is closed and the pump runs.",
    "Permission to enter the building was granted by the mayor.",
    "Source and binary stars were observed with or without a filter.",
    "The mozilla of the story is a small lizard that lives under a stone.",
    "Please distribute these copies to all members of the club.",
    "This work was published in the public interest and is free to read.",
    "The terms of the contract were published by the ministry either in print or online.",
    "Modify the recipe as you like and redistribute the dough before baking.",
)
