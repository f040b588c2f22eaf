"""siftwell: DataFrame operators that turn semi-structured records into explained, measured recommendations."""
