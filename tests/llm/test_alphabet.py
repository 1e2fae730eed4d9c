import numpy as np

from anamnesis.llm.toxicity import Machine


def test_landmarks_of_many_scripts_keep_their_characters():
    latin = ["^abcdefg", "hijklmno", "pqrstuvw", "xyz01234", "56789$"]
    other = ["".join(chr(at + i) for i in range(8)) for start in (0x3B1, 0x430, 0x627, 0x4E00) for at in range(start, start + 96, 8)]
    machine = Machine(latin + other)
    codes = machine.alphabet.codes(latin + other)
    assert all((row[: len(mark)] > 0).all() for row, mark in zip(codes, latin + other))
    kernel = machine.features(codes) @ machine.features(codes).T
    norms = np.sqrt(np.diag(kernel))
    assert np.allclose(norms, [np.sqrt(sum(v * v for v in machine.alphabet.triples(mark).values())) for mark in latin + other], rtol=1e-3)
    assert machine.margins(["сволочь"])[0] >= 0 and machine.margins([other[-1]])[0] > machine.margins(["qaqaqaqa"])[0]
