"""Online learning over ordered chunks, in batch and as a stream; replay of fields."""
