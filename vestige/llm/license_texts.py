"""Passages of full licence texts, as words, from places of the text that are about equally far from each other; the first
tells the licence.
FULL: licence to (words of the text that each passage stands for, passages)."""

FULL = {
    "Apache-2.0": (402, (
        "apache license version 2 0 january 2004 http www apache org licenses terms and conditions for",
        "representatives including but not limited to communication on electronic mailing lists source code control systems and issue tracking systems that are managed by or",
        "the derivative works and d if the work includes a notice text file as part of its distribution then any derivative works that you",
        "exercise of permissions under this license 8 limitation of liability in no event and under no legal theory whether in tort including negligence contract",
    )),
    "GPL-2.0": (499, (
        "gnu general public license version 2 june 1991 copyright c 1989 1991 free software foundation inc",
        "program or other work which contains a notice placed by the copyright holder saying it may be distributed under the terms of this general",
        "not derived from the program and can be reasonably considered independent and separate works in themselves then this license and its terms do not",
        "code even though third parties are not compelled to copy the source along with the object code 4 you may not copy modify sublicense",
        "software through any other system and a licensee cannot impose that choice this section is intended to make thoroughly clear what is believed to",
        "or other party has been advised of the possibility of such damages end of terms and conditions how to apply these terms to your",
    )),
    "GPL-3.0": (713, (
        "gnu general public license version 3 29 june 2007 copyright c 2007 free software foundation inc",
        "unmodified program or a work based on the program to propagate a work means to do anything with it that without permission would make",
        "direction and control on terms that prohibit them from making any copies of your copyrighted material outside their relationship with you conveying under any",
        "1 a copy of the corresponding source for all the software in the product that is covered by this license on a durable physical",
        "with an implementation available to the public in source code form and must require no special password or key for unpacking reading or copying",
        "of parties who have received copies or rights from you under this license if your rights have been terminated and not permanently reinstated you",
        "one or more identifiable patents in that country that you have reason to believe are valid if pursuant to or in connection with a",
        "permitted by applicable law except when otherwise stated in writing the copyright holders and or other parties provide the program as is without warranty",
    )),
    "LGPL-2.1": (552, (
        "gnu lesser general public license version 2 1 february 1999 copyright c 1991 1999 free software",
        "for a version of the library must be consistent with the full freedom of use specified in this license most gnu software including some",
        "such software library or work which has been distributed under these terms a work based on the library means either the library or any",
        "and can be reasonably considered independent and separate works in themselves then this license and its terms do not apply to those sections when",
        "such executables when a work that uses the library uses material from a header file that is part of the library the object code",
        "of performing this distribution d if distribution of the work is made by offering access to copy from a designated place offer equivalent access",
        "reason not limited to patent issues conditions are imposed on you whether by court order agreement or otherwise that contradict the conditions of this",
        "15 because the library is licensed free of charge there is no warranty for the library to the extent permitted by applicable law except",
    )),
    "LGPL-3.0": (311, (
        "gnu lesser general public license version 3 29 june 2007 copyright c 2007 free software foundation",
        "license without being bound by section 3 of the gnu gpl 2 conveying modified versions if you modify a copy of the library and",
        "in it and that the library and its use are covered by this license b accompany the combined work with a copy of the",
        "based on the library side by side in a single library together with other library facilities that are not applications and are not covered",
    )),
    "MPL-2.0": (405, (
        "mozilla public license version 2 0 1 definitions 1 1 contributor means each individual or legal",
        "a legal entity exercising rights under this license for legal entities you includes any entity that controls is controlled by or is under common",
        "creation s or it has sufficient rights to grant the rights to its contributions conveyed by this license 2 6 fair use this license",
        "warranty or limitations of liability contained within the source code form of the covered software except that you may alter any license notices to",
        "initiate litigation against any entity by asserting a patent infringement claim excluding declaratory judgment actions counter claims and cross claims alleging that a contributor",
        "bring cross claims or counter claims 9 miscellaneous this license represents the complete agreement concerning the subject matter hereof if any provision of this",
    )),
    "CC-BY-SA-4.0": (472, (
        "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution sharealike 4 0 international public license",
        "terms and conditions and the licensor grants you such rights in consideration of benefits the licensor receives from making the licensed material available under",
        "chosen by them l sui generis database rights means rights other than copyright resulting from directive 96 9 ec of the european parliament and",
        "public license nor are publicity privacy and or other similar personality rights however to the extent possible the licensor waives and or agrees not",
        "license you apply section 4 sui generis database rights where the licensed rights include sui generis database rights that apply to your use of",
        "of the violation or 2 upon express reinstatement by the licensor for the avoidance of doubt this section 6 b does not affect any",
    )),
}
