"""Operations for building training corpora. Nothing outside imports this."""
