"""The headers that public licences ask for, and their titles."""

_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the {name} \
as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied \
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.

You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>."""
_GNU_ONLY = """This program is free software; you can redistribute it and/or modify it under the terms of the {name} \
version {version} as published by the Free Software Foundation."""
_GNU_NAMES = [
    ("gpl-2.0", "GNU General Public License", "2"),
    ("gpl-3.0", "GNU General Public License", "3"),
    ("lgpl-3.0", "GNU Lesser General Public License", "3"),
    ("agpl-3.0", "GNU Affero General Public License", "3"),
]
_CC = [
    ("cc-by-4.0", "Attribution", "by"),
    ("cc-by-sa-4.0", "Attribution-ShareAlike", "by-sa"),
    ("cc-by-nc-4.0", "Attribution-NonCommercial", "by-nc"),
]
HEADERS = [
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in \
compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific \
language governing permissions and limitations under the License.""",
    ),
    (
        "mpl-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL \
was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    (
        "cc0-1.0",
        """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring \
rights to this software to the public domain worldwide. This software is distributed without any warranty.

You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see \
<http://creativecommons.org/publicdomain/zero/1.0/>.""",
    ),
    *((key, _GNU.format(name=name, version=version)) for key, name, version in _GNU_NAMES),
    *((key, _GNU_ONLY.format(name=name, version=version)) for key, name, version in _GNU_NAMES),
    *(
        (key, f"This work is licensed under the Creative Commons {name} 4.0 International License. To view a copy of this "
         f"license, visit http://creativecommons.org/licenses/{short}/4.0/.")
        for key, name, short in _CC
    ),
]
TITLES = [
    ("mit", "MIT License"),
    ("mit", "The MIT License (MIT)"),
    ("apache-2.0", "Apache License"),
    ("apache-2.0", "Apache License Version 2.0, January 2004"),
    ("bsd-3-clause", "BSD 3-Clause License"),
    ("mpl-2.0", "Mozilla Public License Version 2.0"),
    ("cc0-1.0", "CC0 1.0 Universal"),
    ("gpl-2.0", "GNU General Public License Version 2, June 1991"),
    ("gpl-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("lgpl-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("agpl-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    *((key, f"Creative Commons {name} 4.0 International Public License") for key, name, _ in _CC),
]
