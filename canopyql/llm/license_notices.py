"""Sentences and names by which license texts, headers and notices are known, as lower-case words with single blanks between.

Fixed values: the wording is that of the licenses themselves. Each line has a priority (4 denies a grant, 3 declares, 2 grants or is a license's own
text, 1 mentions), a label, and a regular expression over the words."""

NOTICES = r"""
4 - not (?:be )?licen[cs]ed under (?:the )?(?:[a-z0-9]+ ){1,8}?licen[cs]e
4 - (?:is|are|was|were) not (?:released|distributed|published|available|covered) under (?:the )?(?:terms of )?(?:the )?(?:[a-z0-9]+ ){1,8}?licen[cs]e
4 - no longer (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:[a-z0-9]+ ){1,8}?licen[cs]e
2 mit permission is hereby granted free of charge to any person obtaining a copy
2 mit the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software
2 mit the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
2 mit in no event shall the (?:above )?(?:authors?|copyright holders?)(?: or copyright holders?)? be liable for any claim damages or other liability
2 x11 except as contained in this notice the names? of (?:[a-z0-9]+ ){1,12}?shall not be used in advertising or otherwise to promote the sale
2 bsd redistribution and use in source and binary forms with or without modification are permitted
2 bsd redistributions? of source code must retain the above copyright notice
2 bsd redistributions? in binary form must reproduce the above copyright notice
2 bsd-3-clause neither the names? of (?:[a-z0-9]+ ){1,14}?nor the names of its contributors may be used to endorse or promote products
2 bsd-3-clause the names? of (?:[a-z0-9]+ ){1,12}?may not be used to endorse or promote products derived from this software
2 bsd-4-clause all advertising materials mentioning features or use of this software must display the following acknowledgement
2 bsd this software is provided by the (?:[a-z0-9]+ ){1,6}?as is and any express or implied warranties
2 isc permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
2 isc the software is provided as is and the author disclaims all warranties with regard to this software
2 hpnd permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose (?:is hereby granted )?without fee
2 postgresql permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
2 fsfap copying and distribution of this file with or without modification are permitted in any medium without royalty
2 fsful this configure script is free software the free software foundation gives unlimited permission to copy distribute and modify it
2 apache-2 licensed under the apache license version 2 0 the license
2 apache-2 you may not use this file except in compliance with the license
2 apache-2 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
2 apache-2 apache license version 2 0 january 2004
2 apache-2 apache org licenses license 2 0
2 apache-2 each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
2 apache-1.1 this product includes software developed by the apache software foundation
2 apache-1.1 the names apache and apache software foundation must not be used to endorse
2 gpl this (?:program|file|package|software) is free software you can redistribute it and or modify it under the terms of the gnu general public license
2 lgpl this (?:library|program|file|software) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
2 agpl this (?:program|file|software) is free software you can redistribute it and or modify it under the terms of the gnu affero general public license
2 gpl you should have received a copy of the gnu general public license
2 lgpl you should have received a copy of the gnu (?:lesser|library) general public license
2 agpl you should have received a copy of the gnu affero general public license
2 gpl-2 (?:under the terms of|of) the gnu general public license (?:version 2 )?as published by the free software foundation either version 2 of the license
2 gpl-3 (?:under the terms of|of) the gnu general public license as published by the free software foundation either version 3 of the license
2 gpl-2 gnu general public license version 2 june 1991
2 gpl-3 gnu general public license version 3 29 june 2007
2 lgpl-2 gnu library general public license version 2 june 1991
2 lgpl-2.1 gnu lesser general public license version 2 1 february 1999
2 lgpl-3 gnu lesser general public license version 3 29 june 2007
2 agpl-3 gnu affero general public license version 3 19 november 2007
2 gpl the licenses for most software are designed to take away your freedom to share and change it
2 gpl this program is distributed in the hope that it will be useful but without any warranty
2 lgpl this library is distributed in the hope that it will be useful but without any warranty
1 gpl gnu org licenses (?:old licenses )?gpl
1 lgpl gnu org licenses (?:old licenses )?lgpl
1 agpl gnu org licenses agpl
1 gfdl gnu org licenses (?:old licenses )?fdl
2 gfdl permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
1 gfdl gnu free documentation license
1 gpl-classpath-exception linking this library statically or dynamically with other modules is making a combined work based on this library
1 gpl-classpath-exception classpath exception(?: 2 0)?
2 mpl-2 this source code form is subject to the terms of the mozilla public license v 2 0
2 mpl-2 if a copy of the mpl was not distributed with this file you can obtain one at
1 mpl-2 mozilla org mpl 2 0
2 mpl-1.1 the contents of this file are subject to the mozilla public license version 1 1
2 epl-1 made available under the terms of the eclipse public license (?:version |v )?1 0
2 epl-2 made available under the terms of the eclipse public license (?:version |v )?2 0
1 epl-1 eclipse org legal epl v10
1 epl-2 eclipse org legal epl (?:v20|2 0)
2 cddl-1 the contents of this file are subject to the terms of the common development and distribution license
2 cpl-1 made available under the terms of the common public license
2 unlicense this is free and unencumbered software released into the public domain
2 unlicense anyone is free to copy modify publish use compile sell or distribute this software
1 unlicense unlicense org
2 cc0-1 has waived all copyright and related or neighboring rights
1 cc0-1 creativecommons org publicdomain zero 1 0
1 cc-by creativecommons org licenses by [1-4] [05]
1 cc-by-sa creativecommons org licenses by sa [1-4] [05]
1 cc-by-nd creativecommons org licenses by nd [1-4] [05]
1 cc-by-nc creativecommons org licenses by nc [1-4] [05]
1 cc-by-nc-sa creativecommons org licenses by nc sa [1-4] [05]
1 cc-by-nc-nd creativecommons org licenses by nc nd [1-4] [05]
1 cc-by cc by [1-4] [05]
1 cc-by-sa cc by sa [1-4] [05]
1 cc-by-nd cc by nd [1-4] [05]
1 cc-by-nc cc by nc [1-4] [05]
1 cc-by-nc-sa cc by nc sa(?: [1-4] [05])?
1 cc-by-nc-nd cc by nc nd(?: [1-4] [05])?
2 cc-by you are free to share copy and redistribute the material in any medium or format
2 boost-1 boost software license version 1 0 august 17th 2003
2 boost-1 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
1 boost-1 boost org license 1 0 txt
2 zlib this software is provided as is without any express or implied warranty in no event will the authors? be held liable for any damages
2 zlib altered source versions must be plainly marked as such and must not be misrepresented as being the original software
2 zlib the origin of this software must not be misrepresented you must not claim that you wrote the original software
2 zlib this notice may not be removed or altered from any source distribution
2 wtfpl do what the fuck you want to public license
2 wtfpl you just do what the fuck you want to
2 beerware you can do whatever you want with this stuff if we meet some day
1 beerware beer ?ware license
2 json the software shall be used for good not evil
2 artistic-1 the intent of this document is to state the conditions under which a package may be copied
2 artistic-1 (?:under|on) the same terms as perl itself
2 artistic-2 everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed this license establishes the terms
2 python-2 this license agreement is between the python software foundation psf and the individual or organization
1 python-2 python software foundation license
2 openssl this product includes software developed by the openssl project for use in the openssl toolkit
2 ssleay this product includes cryptographic software written by eric young
2 ofl-1.1 this font software is licensed under the sil open font license version 1 1
1 ofl-1.1 scripts sil org ofl
2 odbl-1 made available under the open database license
1 odbl-1 opendatacommons org licenses odbl
1 odc-by opendatacommons org licenses by
1 pddl opendatacommons org licenses pddl
2 ms-pl this license governs use of the accompanying software if you use the software you accept this license
1 ms-pl microsoft public license
1 ms-rl microsoft reciprocal license
2 eupl-1.2 licen[cs]ed under the eupl
1 sspl-1 server side public license
1 bsl-1.1 business source license 1 1
1 ncsa university of illinois ncsa open source license
1 upl-1 universal permissive license
1 w3c w3c software (?:and document )?(?:notice and )?license
1 unicode unicode inc license agreement data files and software
1 afl-3 academic free license(?: version)?(?: v)?(?: 3 0)?
1 osl-3 open software license(?: version)?(?: v)?(?: 3 0)?
1 qpl q public license
1 sleepycat sleepycat license
1 ecl-2 educational community license
1 lppl latex project public license
1 mulan-psl mulan (?:permissive software license|psl)
1 blueoak-1 blue oak model license
1 parity parity public license
1 polyform-noncommercial polyform noncommercial license
1 elastic-2 elastic license(?: 2 0)?
1 commons-clause commons clause
1 hippocratic hippocratic license
1 cecill cecill (?:[bc] )?(?:free software )?licen[cs]e
1 openldap openldap public license
1 sun-public sun public license
1 ibm-public ibm public license
1 reciprocal reciprocal public license
1 zope zope public license
1 apsl apple public source license
1 eiffel eiffel forum license
1 fair fair license
1 nasa nasa open source agreement
1 php-3 php license version 3 0
1 ogl open government licen[cs]e
1 llama llama (?:[0-9 ]+ )?community license
1 openrail (?:creativeml )?open ?rail m(?: license)?
1 cdla-permissive community data license agreement permissive
1 cdla-sharing community data license agreement sharing
1 free-art free art license
1 ncgl non commercial government licen[cs]e
1 all-rights-reserved all rights reserved
1 all-rights-reserved no part of this (?:publication|book|document|work) may be reproduced
1 proprietary proprietary and confidential
1 proprietary confidential and proprietary
2 proprietary unauthorized (?:copying|use|reproduction) of this file via any medium is strictly prohibited
2 proprietary trade secrets? of (?:[a-z0-9]+ ){1,6}?and (?:is|are) protected by
1 noncommercial for non ?commercial use only
1 noncommercial for (?:research|educational|academic|personal) (?:use|purposes) only
1 noncommercial may not be used for commercial purposes
1 freeware this software is freeware
1 shareware this software is shareware
1 public-domain (?:in|into|to) the public domain
1 public-domain dedicated to the public domain
1 public-domain no copyright is claimed
1 copyleft copyleft(?: all wrongs reserved)?
"""


def notices() -> list[tuple[int, str, str]]:
    """(priority, label, expression) of each line."""
    return [(int(p), label, rx) for p, label, rx in (line.split(" ", 2) for line in NOTICES.strip().splitlines())]
