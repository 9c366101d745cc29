"""loamstone.functions"""
