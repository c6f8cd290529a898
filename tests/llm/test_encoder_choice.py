from sparkloom.llm import encoding as E


def test_encoder_by_vocabulary():
    assert type(E.encoder_of(E.tokenizer_path("word_bpe_49k.json"))) is E.WordEncoder
    assert type(E.encoder_of(E.tokenizer_path("byte_bpe_50k.json"))) is E.LibraryEncoder
