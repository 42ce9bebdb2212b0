"""Canonical digests of whole standard licences, by SPDX identifier.

Made by ``forms`` from the texts that Debian ships in /usr/share/common-licenses, and
``licences.canonical`` with the spellings of the known short texts; the texts themselves are not kept."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Debian's file -> (identifier, title lines, how many of these may be left out).
SOURCES = {
    "Apache-2.0": ("Apache-2.0", 3, (0, 1, 3)), "Artistic": ("Artistic-1.0-Perl", 1, (0, 1)), "BSD": ("BSD-3-Clause", 0, (0,)),
    "CC0-1.0": ("CC0-1.0", 2, (0, 1, 2)), "GFDL-1.2": ("GFDL-1.2", 2, (0, 2)), "GFDL-1.3": ("GFDL-1.3", 2, (0, 2)),
    "GPL-1": ("GPL-1.0", 2, (0, 2)), "GPL-2": ("GPL-2.0", 2, (0, 2)), "GPL-3": ("GPL-3.0", 2, (0, 2)),
    "LGPL-2": ("LGPL-2.0", 2, (0, 2)), "LGPL-2.1": ("LGPL-2.1", 2, (0, 2)), "LGPL-3": ("LGPL-3.0", 2, (0, 2)),
    "MPL-1.1": ("MPL-1.1", 2, (0, 2)), "MPL-2.0": ("MPL-2.0", 1, (0, 1)),
}
END = "END OF TERMS AND CONDITIONS"
#: The publisher's addresses; a text has one of them throughout.
ADDRESSES = (
    r"51 Franklin St(?:reet)?, Fifth Floor,\s+Boston,\s+MA\s+02110-1301,?\s+USA",
    ("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA",
     "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "675 Mass Ave, Cambridge, MA 02139, USA"),
)


def forms(name: str, text: str) -> Iterator[str]:
    """The usual forms of a whole text: with its title or without, with the appendix on its use or
    without (and with or without the line before it), with each of the publisher's addresses."""
    _, titles, dropped = SOURCES[name]
    lines = text.replace("\f", "\n").split("\n")
    heads = [i for i, x in enumerate(lines) if re.search(r"\w", x)][:titles]
    # The first title line of some is a general one, the last of others an address of the text.
    for n in dropped:
        out = heads if n == titles else heads[-n:] if n and name == "Apache-2.0" else heads[:n]
        rest = "\n".join(x for i, x in enumerate(lines) if i not in out)
        ends = [rest]
        if END in rest:
            cut = rest.index(END)
            ends += [rest[:cut], rest[:cut + len(END)]]
        for body in ends:
            yield body
            for address in ADDRESSES[1]:
                yield re.sub(ADDRESSES[0], address, body)
    if name == "BSD":
        yield "BSD 3-Clause License\n\n" + text


#: identifier -> SHA-256 of the canonical forms.
WHOLE = {
    "Apache-2.0": (
        "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b",
        "2957b1f9652ca7bfee8c8a79613378d4b8bdeafb453888be79bb1fc9611f1b68",
        "455fbe61603d62338c6617b3b07eeab657873f2ae33975a9d311550e2aedf2bc",
        "6aa661403864282a4d084f1551e8149a5f1a7b5e8b05b6db8e1a8a28d0badc64",
        "d7dd8e5c661e35d656a43688fc21624b0ba52216e4c419c747129bf83780d165",
        "d849700f6ffe2241c4de5c4f77cc6ee7a152ddfbb1ec7385106677e743be07a7",
        "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe",
        "fb388936c12fba660a278043424b3f9a17c6b2e536674e390813ac3d06e7e73a",
        "fccd588d9a02ef61880aac3c928b77e2e616a70c83ab59267de2144093917d17",
    ),
    "Artistic-1.0-Perl": (
        "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702",
        "4eaaa9e33aeef0af0ff83ab5edac0ad421a1da9cc861c564630460107b4b772c",
    ),
    "BSD-3-Clause": (
        "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651",
        "69fcedb70fd1930cb5d773bb71eb605a3aec6362c678302194666d60ca468f71",
    ),
    "CC0-1.0": (
        "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
        "a142ae38742c8c4c35f5fa19e0a40ebfa60fc38535daf9c570ca3d7e012e1e32",
        "e3ba2aff64372f535373996fe68b166f9e97dc1ead5b471981213ebb8f310ad6",
    ),
    "GFDL-1.2": (
        "2f1a0498221587b397469344ab897095ce242b0776f85e00678df78fd17b0053",
        "31d1e54824dc6954a36d4d6510f749ab693be943260bc59079362a26ad74ea17",
        "46df66eb30fadb738a42b19ccce2f18a583866e5837bccc790b4acff41ba12da",
        "774142f7f9d180b719ac1fe23dfba3589d91276d948e4dd116cb8811cec60691",
        "915561db8eb69b9193eeb710593d298365e0c52787feb731c684977d5b417af7",
        "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60",
        "bb893add3d24a414e0a92d05a8bb9175e4bf95c571ef7d75e90c171148d977f5",
        "d445ab3336df310a32296d121e8ac7517fb258a8fb065fed8e1dbba0347b2973",
    ),
    "GFDL-1.3": (
        "3c426fbfcdf22792d87bb85fe1538455be3c49904a6d4c0f754f86b16154c8bf",
        "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826",
    ),
    "GPL-1.0": (
        "1b19b24f361646cf4f197155866d72e9f0d5011031bb1351fcf10e24aa2f7b35",
        "3b2524d27cb227016df68d1515394e8993b4bbf50c77d600de91a4399cb28f90",
        "41020c05cfcb8b166bdf0c64e7f5f539feb5e7694933cf7d3bb79f6accd702b2",
        "422dc6ece1afadb367f2bcdbf6ac496f4c7ad5c973c45cdd09ae377ceb4c8a12",
        "4a0d740eb4453dafe0e6d04e2d2e4f04c7c85bc1fbef96bc056ea93e7c1c36bc",
        "542eb44393b47446e7b5d9abb98b24262db09390d5986f0fb6feef9ead833086",
        "5eba6902f4038a84a80879771855363939c7b81b83d57e7a776812d6d04c1b9b",
        "5fcc149debc187a5439faada41342d88a9040d1fed00ca78f543889aa201bb79",
        "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc",
        "71fa4bd5fde166ce4fa896f8698e1bcf77024e8a262598b2ea4d3bcad7b6812f",
        "733356cadf8ca8b0ac2db2d593fb7c1a2b0528c7e891f8a911fdaeb64719fff5",
        "757ffb088f9f72935901695e43cf367636fc5a38bf315f11f0ea64e46f5d1ef9",
        "7b86297a2762700b078231c8b488809b0f63cac5e298d74f4270d251bbef230f",
        "7c09aae3c270285817b370de14a701a9ba0c7d9b56b1c3a7be3b96e6ba5ed01f",
        "858bb219a7a780439b4bc4b70a09728cb4a536c4609a75c282fdaf69c8a85201",
        "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70",
        "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
        "98c96304603be152968c123e484f744c9b51ebd341914aee6eea5c39133891e1",
        "9b80eb3145b87968fde482b384ff47a39c81a9f3f04b7b569a2876c47d7ebdf8",
        "a8a98615692e6d9738a3b77686ce468850d1e9a021d5434c1e1ce3af23286278",
        "ac9f80a0d38a1e001427acb1e9fa5f9a23aee35e40ee2759901306fd4e382697",
        "b80c75f62f77e4b5c92f32edee9a5be7c924cc651474d90840fecc602674a983",
        "c0734228e33375b72256fed50d8056b50049dff71f408765af98cd4384a7434a",
        "efcbd5d5f621ec465277efcb03890a7fae6d9253e17b05ef7d7c6f90729a0fc9",
    ),
    "GPL-2.0": (
        "075bcb76902921614c275e6562daee18b3c9f48b9c4c92b8b99ba3df00093abb",
        "1188bd946c8b086fe6ea384131bc5e4725728e74e0fe1902762c9c87ec4bd36a",
        "2abe4f2f5ebff4aa8ed567a0cea0b9820cd074d9d7eda91d90df08701b51faa2",
        "3f6302b11b06e2ba13b2ac80ac77a1979662ab69ce0b459e03a0238dd35d3518",
        "403ef646951799380f6649a9a9c05cad95d64f4003a8c7476b27b490acddcf33",
        "4767c85efb312bbe244abef9b752be38b44e810f05ed9bfae182caf068d13fd3",
        "58f387b55eb95a9c5a6ef16e9064e1bfa9420a69181c677ee6eddf6ed1397cfd",
        "5f3bcd48294d593b7647e36010d614bf45bfe3e5950aa6673782a092bbacc1af",
        "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808",
        "78e9c9f811bd1ba04ed6d619d3e51a759305d2f124cee9defa3535ba4a24bd25",
        "8fa94d3d812775805528fff117ea835ed908322b039e129b957550c1e107d3e2",
        "a268f9c0a6d81f308a4286dac3b04b899da32e1ba02acf6eb78972ce623846e1",
        "a96310c0126886e41d533f45005d1a2f38ac925a3bfaef1a8130b81d073307d0",
        "aa75d54e4fbfdf0a9492e3f5d4ad1f93867a5fdd23c216c603d22461524ce1ce",
        "ac164c60817349dc341fb503710f678c9f8afc5af87c7534931cf1bcd6e31e13",
        "acaf68e303fe7610fff5b930bace57b87821d132bc434f4a104512da48f8bb6c",
        "b1abfb46077acd6c0450274e16fe4cb4610ec546c090c5977a069c5f74340774",
        "b1db576b0501c5696808df9f75d6c49f526e764a8f5a6dc589439bdd50b426b0",
        "ba8b5323b72bf2f2c5d07074133b38292e0fa23fde8fa48771ba8a04cccacddd",
        "cc5e906da6be25c1bd7043d43b6ae593952ed18b205716a7cd5c93213491d778",
        "d111d1c24a44c987fb91de3ce5aab3ec35d8061a2c8a41ffaa8bb64c47df6960",
        "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34",
        "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
        "f285bc3733cac5b521b9507129b185a5f644847c954d9c5081d2405c9043b624",
    ),
    "GPL-3.0": (
        "04a10e711844fe517f9ffba9481db6a825f2f268002c49184ecb8c942911bff3",
        "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191",
        "4868f466a3292b095d887ce2ca00548d3969efb48c33f6aced9a20c59f578c19",
        "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636",
        "ce818a0d5cb7a9a9261f63641713dbb4ca4750284738a6c3f546d86d81a541d2",
        "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a",
    ),
    "LGPL-2.0": (
        "084782a05c82d5e85c704f06bab601971e84b3b9b90a51c95ffcff2b342d9cf2",
        "09bda551cd6a1058f0e9053b4e2fcc0bfb193e8bb1e1485734c5113235b4a30d",
        "2652838d994cbfd49626674c95d3dd21f6f86da9dcd7b97e2a33347147ba5323",
        "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2",
        "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260",
        "542237188ef845a737d1eab5621ecfea8c3310f513f6ff72ad59d1d500e84b63",
        "5ce88337a2fce97b0f2b6aac63afc49927c0dc31e15bf530a83e603e1d298d8b",
        "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
        "6e6982d8bb4468c5ce7a88e400f1540201513f39e8dd96e3607ee631b813c06f",
        "736aa88e50cf3c3ea93c80a3b9a349833dd1b381c6a9c336770f2c61822e164a",
        "81ecf332fc652bb79c23397a1431c72d1f39f01ffdcec61843942283b44f4688",
        "aa06ce7f6e464e73e65ec0efa0bc575ef5bb7059ae0137ab610c2e57b32ca95c",
        "ad81fc738f377aeba41fc24738c2e644becc9d2b6dc33ae94d1d1b9c5658fdd8",
        "bdb969a377f6160f4ad0ed61171a77004650a9c2517d62828be29f35b6bf6b31",
        "cb25e5e1095347e992d553a6b90ba28c3eb94162214d5bcb01d79a61f270448e",
        "cbc927caf696ef44b2fbebe29ffa45a5fccf0a64c78f2b85678a11032ebb3318",
        "cd0909403712694c9ea18a84f7dbb5d566c041db3dbd0e334cd930c31dfea7df",
        "cfdb5c66c66bf96ca974b33dd3db756e6c7eb3329f999c38c122137bdb4be319",
        "d40504a2bf1a1a86ee76e642ced31126577d21774b1ac0a222ce730ec78d7108",
        "d8f786929d4cd5e353f34a8b5fff503ac6cad8e24ee35ceb9eea0d2298b7b4ef",
        "dc842683831d008ff5f32600206cfd765e4d05df71fe831b1b4b31462fa2fff1",
        "e3486a0000bbe009f718d654729c9fbce91815811f5429e302cbc6cf9f016320",
        "f0daec6a0f573603d63948a57e952939050886941e593ad62f992f20e0a12443",
        "feb45efa998ac9d6ca85b1b2b7dfb124a14b1e88f579d2de38fe3a7970ce7380",
    ),
    "LGPL-2.1": (
        "081a6ecff0c8e50ab92b129954441c5d8fbc8f1f5a8987bf8d9225cde97aee2c",
        "0de2e3ba00ed5f309ce9d71663e50ea414063f6e46865f2d80d4ad038f268c87",
        "127c98b05c4e2851a27843fcf90984e5592c3841d8a6b7638dbcd00bcefe46dd",
        "1d2a09e288311515cd0682b55db758224412a4901ca0578bf16420229d5190c4",
        "20136473d72f8fa2c8e3998adda1cf5676c9bac2bb48f059ee804302841a5fb5",
        "3bde1ca18489d8594a2c0c04b5ae1003c1795d1680675f4ef758325e1e1c3169",
        "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4",
        "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
        "580d668437368921310389889745ec2a76860b0f634a684ce33c6a4e5d106957",
        "5c42345581e1857951a2f5c540eae7981a9540e2d41028f448a195bb48dd33f0",
        "62470f8c7f6c88c1c89d5e4080fc0969a43f31055e91336c089eb0ad2152027b",
        "63a9e54a9c20816b2c240f12cda2ee7d6c9f2bfb426b706197a99f75ada62c9a",
        "77e5acffdb4b83d2e3ef8f1feb41cc7d5c859e0f7b2a31236b807ddc4248f9f5",
        "925c28788af11361f32b5b10dbeb4454be64e8448ed4a7c0926618a5d8a85bfb",
        "98d365a8217633113a201b5777e4d26ae0eb1d88079c5e39838162abe1f18db4",
        "a5ac783c64dc7fa3fe7b641692ee7b8da491bd87f613c9bb99618a9469e71c47",
        "b11e56f26e36c27490673d8fa272b68666cfd474b64e23db5244d0ccde21fa9e",
        "bd06b7347431b0fc243c0e32d1668ab362329b4a591386570abd310334f6fbdb",
        "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df",
        "c9369494bc3c8d01995b30224c6aa0af52dd5fcb01230fbedb398a6d454a03bd",
        "df8b7d554d9ba4683d95046dc0cd8fdf6c063841a3cfabcf242ab40e69237421",
        "e8379077377b4f1cf6d306654dca012e99fec5e9a13474071c353ba3557fc48b",
        "e94f6c31379c2076fae91e236d6000ea55d918637fc8f30749aa0fe22a265c7f",
        "fe1e4e79e75a761f9e18e6c55697cba51fe044489eb12d24fd4231b83ef47132",
    ),
    "LGPL-3.0": (
        "13980739d6423be0921994d8ce3ce547437735b0e6733161f70b19c962f194b7",
        "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    ),
    "MPL-1.1": (
        "34386b9a926117ec1b973ef1b1ef8fba50be254811addc9f9659bcc5d5a096bf",
        "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6",
    ),
    "MPL-2.0": (
        "c0f855aacb6ac1c86bcdd1334db61014d14898798ae14888fea5446cbb9d32e3",
        "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
    ),
}
