"""Licence families: short notices and reference sentences of each."""

#: Usual wordings of licence notices, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
}

#: Names and identifiers by family, as they stand alone, in badges and in file headers.
NAMES: dict[str, tuple[str, ...]] = {
    "apache": ("Apache-2.0", "Apache License 2.0", "Apache License, Version 2.0"),
    "mit": ("MIT", "MIT License", "The MIT License"),
    "gpl": ("GPL-3.0-or-later", "GPL-2.0-only", "GPLv3", "GPLv2", "GPLv3 or later", "GNU General Public License"),
    "lgpl": ("LGPL-2.1-or-later", "LGPL-3.0", "LGPLv3", "GNU Lesser General Public License"),
    "bsd": ("BSD-3-Clause", "BSD-2-Clause", "BSD License", "BSD 3-Clause License"),
    "mpl": ("MPL-2.0", "Mozilla Public License", "Mozilla Public License 2.0"),
    "cc-by": ("CC-BY-4.0", "CC BY 4.0", "Creative Commons Attribution 4.0"),
    "cc-by-sa": ("CC-BY-SA-4.0", "CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0"),
    "cc-by-nc": ("CC-BY-NC-4.0", "CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0"),
}
#: What stands around a name; {} is the name.
AROUND: tuple[str, ...] = ("{}", "SPDX-License-Identifier: {}", "License: {}", "Licensed under {}", "Released under the {}", "licensed {}")

#: Sentences about rights that name no family, for the unknown class.
UNKNOWN: tuple[str, ...] = (
    "All rights reserved.",
    "Copyright by the authors. All rights reserved.",
    "See the license file for details.",
    "The license of this text is not known.",
    "You must accept the terms of the agreement before you use the software.",
    "This software is provided under a commercial licence; contact the vendor for a copy.",
    "The public may view this work free of charge in the library.",
    "Version 2.0 of the program was released in the spring.",
    "Distributed under the terms of the seller's own agreement.",
    "A general election and a public hearing were held under the new law.",
)
