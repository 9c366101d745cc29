"""loamstone.streaming"""
