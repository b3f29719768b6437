from runweave.sources.generate import draw_shares, draw_sorted, draw_uniform, generate_sorted, generate_uniform
from runweave.sources.numbers import LINE_ORDER, number_lines, read_number_files, read_numbers, write_numbers

__all__ = [
    "LINE_ORDER", "draw_shares", "draw_sorted", "draw_uniform", "generate_sorted", "generate_uniform", "number_lines",
    "read_number_files", "read_numbers", "write_numbers",
]
