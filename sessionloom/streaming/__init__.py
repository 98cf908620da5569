"""sessionloom.streaming"""
