from quayline.cli import main

if __name__ == "__main__":
    print(f"{main()} rows")
